"""Queries over texts: cleaning, chunking, structure, normalizers, similarity, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import cleaning as C
from lodeweave.functions import normalizers as N
from lodeweave.functions import similarity as S
from lodeweave.hooks import prompt_statistics, render
from lodeweave.operators import chunking, graph, retrieval, structure
from lodeweave.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunk_fixed(spark, sf_dir):
    out = chunking.fixed_chunks(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "chunk_id", "start_char", "end_char", F.md5("chunk").alias("digest"))


def chunk_token(spark, sf_dir):
    out = chunking.token_chunks(_docs(spark, sf_dir).select("doc_id", "text"), size=120, overlap=20)
    return out.select("doc_id", "chunk_no", "n_tokens", F.md5("chunk").alias("digest"))


def html_strip(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(C.strip_html(F.col("text"))).alias("digest"))


def markdown_strip(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(C.strip_markdown(F.col("text"))).alias("digest"))


def secret_scan(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(C.has_secret(F.col("text"))).alias("with_secret"))


def adjacent_dedupe(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(C.dedupe_adjacent(F.col("text"))).alias("digest"))


def garbage_lines(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(C.drop_garbage(F.col("text"))).alias("digest"))


def whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(C.fix_whitespace(F.col("text"))).alias("digest"))


def clean_native(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", C.clean_native(F.col("text")).alias("text"))


def clean_full(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", C.clean(F.col("text")).alias("text"))


def language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.language(F.col("text")).alias("guess"))


def repeated_lines(spark, sf_dir):
    """Lines at the edges of documents that many documents of one source and type share."""
    pages = _docs(spark, sf_dir).where("text is not null").select(F.concat_ws("/", "source", "doc_type").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return structure.repeated_lines(structure.page_lines(pages), share=0.02)


def normalize_labels(spark, sf_dir):
    x = table(spark, sf_dir, "kg_inferred").select(F.col("subject.label").alias("label")).where("label is not null").distinct()
    c = F.col("label")
    return x.select(
        "label", N.evaluation(c).alias("evaluation"), N.domain(c).alias("domain"), N.consolidation(c).alias("consolidation"), N.grouping(c).alias("grouped"), N.compatibility(c).alias("compat"), N.spacing(c).alias("spaced"),
        N.benchmark(c).alias("bench"), N.schema_label(c).alias("schema_label"), N.slug(c).alias("slug"), N.compare_key(c).alias("compare_key"), N.line_key(c).alias("line_key"),
    )


def relation_names(spark, sf_dir):
    x = table(spark, sf_dir, "kg_inferred").select(F.col("predicate.label").alias("label")).where("label is not null").distinct()
    return x.select("label", N.relation(F.col("label")).alias("relation"))


def label_similarity(spark, sf_dir):
    k = table(spark, sf_dir, "kg_inferred").where("subject.label is not null and object.label is not null")
    a, b = N.consolidation(F.col("subject.label")), N.consolidation(F.col("object.label"))
    return k.select("row_id", F.round(S.jaccard(a, b), 6).alias("jaccard"), F.round(S.containment(a, b), 6).alias("containment"), F.round(S.trigram_jaccard(a, b), 6).alias("trigram"))


def running_offsets(spark, sf_dir):
    """Places of the snippets of each run laid one after the other."""
    l5 = table(spark, sf_dir, "layer05_candidate_triple_generation")
    s = l5.select(F.col("run_id").alias("doc_id"), "row_id", F.posexplode("provenance").alias("pos", "e")).select("doc_id", "row_id", "pos", F.coalesce("e.snippet", F.lit("")).alias("chunk"))
    return chunking.running_offsets(s, "chunk", ["row_id", "pos"]).select("doc_id", "row_id", "pos", "start_char", "end_char")


def taxonomy_retrieve(spark, sf_dir):
    tax = table(spark, sf_dir, "relation_catalog").select(F.col("canon_label").alias("label"))
    return retrieval.taxonomy_hits(_docs(spark, sf_dir).where("text is not null"), tax)


def artifact_retrieve(spark, sf_dir):
    q = table(spark, sf_dir, "subject_areas").select(F.lower("area_name").alias("query"))
    items = table(spark, sf_dir, "layer06_concept_relation_induction").where("label is not null").select(F.col("element_kind").alias("kind"), F.col("description").alias("text"), F.col("row_id").alias("ord")).where("text is not null")
    q = q.unionByName(spark.createDataFrame([("the filter",), ("a fuse",), ("the cable had",)], "query string"))
    return retrieval.artifact_space(q, items, 5)


def prompt_stats(spark, sf_dir):
    k = table(spark, sf_dir, "kg_inferred")
    p = k.select("source_code", render("Is $s related to $o?", s=F.col("subject.label"), o=F.col("object.label")).alias("prompt"))
    return prompt_statistics(p, ["source_code"])


def event_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg(F.expr("try_cast(value as double)")), 4).alias("mean"), F.count_if(F.col("value") > 50).alias("high"))


def top_labels(spark, sf_dir):
    k = table(spark, sf_dir, "kg_inferred").select("source_code", F.col("predicate.label").alias("label"))
    return graph.top_labels(k, ["source_code"], "label")


def _step(step):
    """A query of one cleaning step over all texts."""
    return lambda spark, sf_dir: _docs(spark, sf_dir).where("text is not null").select("doc_id", F.md5(step(F.col("text"))).alias("digest"))


#: Single steps of the cleaning pipeline.
STEPS = {
    "control_strip": C.strip_controls, "hyphen_strip": C.strip_soft_hyphens, "latex_strip": C.strip_latex, "fused_split": C.split_fused, "broken_join": C.join_broken, "dash_fix": C.fix_dashes,
    "header_drop": C.drop_headers, "contents_drop": C.drop_contents, "spaced_letters": C.join_spaced_letters, "line_spacing": C.fix_line_spacing, "doubled_glyphs": C.repair_doubles,
}


def nearest_catalog(spark, sf_dir):
    """The three entries of the relation list most like each of the list's French labels."""
    cat = table(spark, sf_dir, "relation_catalog")
    return retrieval.nearest_labels(cat.select(F.col("canon_label_fr").alias("query")), cat.select(F.col("canon_label").alias("label"), F.col("canon_id").alias("ord")), 3)


QUERIES = {f.__name__: f for f in (
    chunk_fixed, chunk_token, html_strip, markdown_strip, secret_scan, adjacent_dedupe, garbage_lines, whitespace, clean_native, clean_full, language, repeated_lines, normalize_labels, relation_names,
    label_similarity, running_offsets, taxonomy_retrieve, artifact_retrieve, prompt_stats, event_summary, top_labels, nearest_catalog,
)} | {name: _step(step) for name, step in STEPS.items()}

_LINES = r"SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL"
_ACCENTS = "strip_accents({0})"
_WORDS = r"trim(regexp_replace(regexp_replace(replace(regexp_replace({0}, '[_/\\:;|]+', ' ', 'g'), '-', ' '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STRAIGHT = "translate({0}, '“”’—–', '\"\"''  ')"
_CAMEL = r"regexp_replace(regexp_replace({0}, '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
_N3 = r"trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_TOK = "list_distinct([w FOR w IN string_split({0}, ' ') IF w <> ''])"
_TRI = "CASE WHEN length({0}) = 0 THEN []::VARCHAR[] ELSE list_distinct([substr({0}, i, 3) FOR i IN generate_series(1, greatest(length({0}) - 2, 1))]) END"
_GRAMS = r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_concat(w, [z[1] || ' ' || z[2] FOR z IN list_zip(w[:-2], w[2:])])) AS g FROM w)
"""
_SECRETS = " OR ".join(f"regexp_matches(text, '{p}')" for p in C.SECRETS)

ORACLE_SQL = {
    "chunk_fixed": "SELECT doc_id, printf('chunk_%04d', (s / 1300)::INT) AS chunk_id, s::INT AS start_char, least(s + 1500, length(text))::INT AS end_char, md5(substr(text, s::INT + 1, 1500)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 1300)) AS s FROM documents WHERE length(text) > 0)",
    "chunk_token": r"WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 21, 0), 100)) AS s FROM w WHERE len(w) > 0) SELECT doc_id, (s / 100)::INT AS chunk_no, len(w[s + 1:s + 120])::INT AS n_tokens, md5(array_to_string(w[s + 1:s + 120], ' ')) AS digest FROM s",
    "html_strip": "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '<div[^>]*>.*?</div>', '', 'gs'), '<svg[^>]*>.*?</svg>', '', 'gs'), '<[^>]+>', '', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "secret_scan": f"SELECT source, count(*) AS n, count(*) FILTER (WHERE coalesce({_SECRETS}, false)) AS with_secret FROM documents GROUP BY 1",
    "adjacent_dedupe": f"WITH l AS ({_LINES}), p AS (SELECT *, last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p WHERE NOT (trim(line) <> '' AND coalesce(trim(line) = prev, false)) GROUP BY 1",
    "garbage_lines": rf"WITH l AS ({_LINES}), d AS (SELECT DISTINCT doc_id FROM l), k AS (SELECT * FROM l WHERE trim(line) = '' OR length(trim(line)) < 4 OR length(regexp_replace(trim(line), '[^\p{{L}}]', '', 'g')) >= 0.3 * length(trim(line))) SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS digest FROM d LEFT JOIN k USING (doc_id) GROUP BY 1",
    "whitespace": rf"WITH l AS ({_LINES}), j AS (SELECT doc_id, string_agg(trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' '), chr(10) ORDER BY i) AS t FROM l GROUP BY 1) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS digest FROM j",
    "language": "WITH w AS (SELECT doc_id, regexp_split_to_array(lower(substr(text, 1, 2000)), '[^\\p{L}]+') AS w FROM documents), s AS (SELECT doc_id, "
    + ", ".join(f"len([x FOR x IN w IF x IN ({', '.join(repr(x) for x in ws)})]) AS {lang}_n" for lang, ws in C.STOP_WORDS.items())
    + " FROM w) SELECT doc_id, CASE WHEN greatest(en_n, fr_n, de_n, es_n) > 0 THEN CASE greatest(en_n, fr_n, de_n, es_n) WHEN en_n THEN 'en' WHEN fr_n THEN 'fr' WHEN de_n THEN 'de' ELSE 'es' END END AS guess FROM s",
    "repeated_lines": r"WITH t AS (SELECT concat_ws('/', source, doc_type) AS doc_id, doc_id AS page, [x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, page, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM t), k AS (SELECT doc_id, page, regexp_replace(regexp_replace(lower(trim(line)), '\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS key, (i < 3 OR i >= n - 3) AS edge FROM e), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM k GROUP BY 1), h AS (SELECT doc_id, key, count(DISTINCT page) AS n_pages FROM k WHERE edge GROUP BY 1, 2) SELECT doc_id, key, n_pages FROM h JOIN p USING (doc_id) WHERE n_pages >= greatest(2, floor(pages * 0.02))",
    "normalize_labels": "WITH x AS (SELECT DISTINCT subject.label AS label FROM kg_inferred WHERE subject.label IS NOT NULL) SELECT label, "
    + _WORDS.format(f"lower({_ACCENTS.format(_CAMEL.format(_STRAIGHT.format('label')))})") + " AS evaluation, " + _WORDS.format(f"lower({_STRAIGHT.format('label')})") + " AS domain, " + _N3.format("label") + " AS consolidation, "
    + r"regexp_replace(regexp_replace(trim(lower(label)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s\-]', '', 'g') AS grouped, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS compat, trim(regexp_replace(lower(label), '\s+', ' ', 'g')) AS spaced, "
    + r"translate(trim(lower(label)), '_-', '  ') AS bench, trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(label), '[_\-]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS schema_label, "
    + r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS compare_key, "
    + r"regexp_replace(regexp_replace(lower(trim(label)), '\s+', ' ', 'g'), '[0-9]+', '#', 'g') AS line_key FROM x",
    "relation_names": "WITH x AS (SELECT DISTINCT predicate.label AS label FROM kg_inferred WHERE predicate.label IS NOT NULL), y AS (SELECT label, regexp_replace(regexp_replace(regexp_replace(translate(upper(strip_accents(trim(label))), ' -', '__'), '[^A-Z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS k FROM x) SELECT label, coalesce(MAP {"
    + ", ".join(f"'{k}': '{v}'" for k, v in N.RELATION_ALIASES.items()) + "}[k], k) AS relation FROM y",
    "label_similarity": f"WITH x AS (SELECT row_id, {_N3.format('subject.label')} AS a, {_N3.format('object.label')} AS b FROM kg_inferred WHERE subject.label IS NOT NULL AND object.label IS NOT NULL), y AS (SELECT row_id, {_TOK.format('a')} AS p, {_TOK.format('b')} AS q, {_TRI.format('a')} AS s, {_TRI.format('b')} AS t FROM x) SELECT row_id, round(CASE WHEN len(p) > 0 AND len(q) > 0 THEN len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) ELSE 0 END, 6) AS jaccard, round(CASE WHEN least(len(p), len(q)) > 0 THEN len(list_intersect(p, q)) / least(len(p), len(q)) ELSE 0 END, 6) AS containment, round(CASE WHEN len(s) > 0 AND len(t) > 0 THEN len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) ELSE 0 END, 6) AS trigram FROM y",
    "running_offsets": "WITH s AS (SELECT run_id AS doc_id, row_id, generate_subscripts(provenance, 1) - 1 AS pos, unnest(provenance) AS e FROM layer05_candidate_triple_generation), t AS (SELECT doc_id, row_id, pos, length(coalesce(e.snippet, '')) AS n FROM s) SELECT doc_id, row_id, pos::INT AS pos, (sum(n + 2) OVER w - 2 - n)::BIGINT AS start_char, (sum(n + 2) OVER w - 2)::BIGINT AS end_char FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY row_id, pos ROWS UNBOUNDED PRECEDING)",
    "taxonomy_retrieve": r"WITH w AS (SELECT doc_id, ' ' || array_to_string([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''], ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT DISTINCT canon_label AS label, ' ' || trim(regexp_replace(lower(canon_label), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS g FROM relation_catalog), h AS (SELECT DISTINCT doc_id, label FROM w JOIN l ON contains(t, g)) SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY label) AS r FROM h) WHERE r <= 40",
    "control_strip": r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "hyphen_strip": "SELECT doc_id, md5(replace(replace(replace(text, chr(173), ''), chr(8203), ''), chr(65279), '')) AS digest FROM documents WHERE text IS NOT NULL",
    "latex_strip": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\$\\[a-zA-Z]+\{[^}]*\}\$', '', 'g'), '\$\\[a-zA-Z]+\$', '', 'g'), '\$[^$]{1,30}\$', '', 'g'), ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "fused_split": r"SELECT doc_id, md5(regexp_replace(text, '([a-zà-ÿ])([A-ZÀ-Ý])', '\1 \2', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "broken_join": r"SELECT doc_id, md5(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "dash_fix": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])\s*---\s*([\p{L}\p{N}_])', '\1-\2', 'g'), '([\p{L}\p{N}_])\s*--\s*([\p{L}\p{N}_])', '\1-\2', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "header_drop": rf"WITH l AS ({_LINES}), d AS (SELECT DISTINCT doc_id FROM l), r AS (SELECT doc_id, i, trim(line) AS line, len(regexp_extract_all(trim(line), '\.{{2,}}\s*\d+')) AS refs, length(line) - length(replace(line, '.', '')) AS dots FROM l), k AS (SELECT * FROM r WHERE line = '' OR NOT (regexp_matches(line, '^[0-9]{{1,3}}$') OR regexp_matches(line, '^\d+\s*/\s*\d+$') OR regexp_matches(line, '^-\s*\d+\s*-$') OR regexp_matches(line, '(?i)^page\s+\d+.*$') OR refs >= 2 OR (refs >= 1 AND dots >= 3))) SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS digest FROM d LEFT JOIN k USING (doc_id) GROUP BY 1",
    "contents_drop": rf"WITH l AS ({_LINES}), d AS (SELECT DISTINCT doc_id FROM l), r AS (SELECT doc_id, i, trim(line) AS line, len(regexp_extract_all(trim(line), '\.{{2,}}\s*\d+')) AS refs, length(line) - length(replace(line, '.', '')) AS dots FROM l), k AS (SELECT * FROM r WHERE line = '' OR NOT (upper(line) = 'INDEX' OR regexp_matches(line, '^\s*\d+(\.\d+)+(\.?[^\n]*)?\s*\d+(-\d+)?\s*$') OR refs >= 2 OR (refs >= 1 AND dots >= 2))) SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS digest FROM d LEFT JOIN k USING (doc_id) GROUP BY 1",
    "spaced_letters": rf"WITH l AS ({_LINES}), w AS (SELECT *, [x FOR x IN regexp_split_to_array(trim(line), '\s+') IF x <> ''] AS w FROM l), s AS (SELECT *, len([x FOR x IN w IF regexp_matches(x, '\p{{L}}')]) AS alpha, len([x FOR x IN w IF regexp_matches(x, '^\p{{L}}$')]) AS single FROM w) SELECT doc_id, md5(string_agg(CASE WHEN single >= 4 AND single >= 0.7 * alpha THEN array_to_string(w, '') ELSE line END, chr(10) ORDER BY i)) AS digest FROM s GROUP BY 1",
    "artifact_retrieve": "WITH q AS (SELECT lower(area_name) AS query FROM subject_areas UNION ALL SELECT * FROM (VALUES ('the filter'), ('a fuse'), ('the cable had'))), i AS (SELECT element_kind AS kind, description AS text, row_id AS ord FROM layer06_concept_relation_induction WHERE label IS NOT NULL AND description IS NOT NULL) SELECT query, kind, text, ord FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, kind, text) AS r FROM q JOIN i ON contains(lower(text), query)) WHERE r <= 5",
    "prompt_stats": "WITH p AS (SELECT source_code, 'Is ' || coalesce(subject.label, '') || ' related to ' || coalesce(object.label, '') || '?' AS p FROM kg_inferred) SELECT source_code, count(*) AS prompts, sum(length(p))::BIGINT AS chars, max(length(p))::INT AS max_chars, round(avg(length(p)), 6) AS avg_chars, sum(greatest(1, length(p) // 4))::BIGINT AS tokens FROM p GROUP BY 1",
    "event_summary": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1",
    "top_labels": "WITH n AS (SELECT source_code, predicate.label AS l, count(*) AS n FROM kg_inferred WHERE predicate.label IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY n DESC, l) AS r FROM n) SELECT source_code, string_agg(l || ' (' || n || ')', ', ' ORDER BY r) AS labels FROM r WHERE r <= 5 GROUP BY 1",
}
