"""SQL of the queries over the graph's tables."""

from __future__ import annotations

from lodeweave.functions.normalizers import RELATION_ALIASES
from lodeweave.plans.text_queries import _STRAIGHT, _WORDS

_N3 = r"trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_N4 = r"regexp_replace(regexp_replace(trim(lower({0})), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g')"
_N6 = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_N13K = r"regexp_replace(regexp_replace(regexp_replace(translate(upper(strip_accents(trim(coalesce({0}, '')))), ' -', '__'), '[^A-Z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_MAP = "MAP {{" + ", ".join(f"'{k}': '{v}'" for k, v in RELATION_ALIASES.items()) + "}}"
_N13 = f"coalesce({_MAP}[{_N13K}], {_N13K})"
_DOMAIN = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(translate(coalesce({0}, ''), '“”’—–', '\"\"''  ')), '[_/\\:;|]+', ' ', 'g'), '-', ' '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_EVAL = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(translate(coalesce({0}, ''), '“”’—–', '\"\"''  '), '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'))), '[_/\\:;|]+', ' ', 'g'), '-', ' '), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{1}')"

_KG = """
kg AS (SELECT row_id, doc_id, run_id, source_code, triple_id, subject.id AS subject_id, subject.label AS subject_label, subject.type AS subject_type, predicate.id AS predicate_id, predicate.label AS predicate_label,
  object.id AS object_id, object.label AS object_label, object.type AS object_type, chunk_id, justification, confidence FROM kg_inferred)
"""
_L5 = "layer05_candidate_triple_generation"
_GP = f"""
g AS (SELECT run_id, {_N3.format('subject_label')} AS head, {_N13.format('predicate_label')} AS relation, {_N3.format('object_label')} AS tail FROM {_L5}),
p AS (SELECT run_id, {_N3.format('subject_label')} AS head, {_N13.format('predicate_label')} AS relation, {_N3.format('object_label')} AS tail FROM kg)
"""
_PRF = "round(coalesce(tp / nullif(pred_n, 0), 0), 6) AS precision, round(coalesce(tp / nullif(gold_n, 0), 0), 6) AS recall, round(coalesce(2 * (tp / nullif(pred_n, 0)) * (tp / nullif(gold_n, 0)) / nullif(tp / nullif(pred_n, 0) + tp / nullif(gold_n, 0), 0), 0), 6) AS f1"


def _counts(p: str, g: str, keys: str) -> str:
    return f"""
pc AS (SELECT {keys}, count(*) AS p FROM {p} GROUP BY ALL), gc AS (SELECT {keys}, count(*) AS g FROM {g} GROUP BY ALL),
c AS (SELECT sum(coalesce(p, 0))::BIGINT AS pred_n, sum(coalesce(g, 0))::BIGINT AS gold_n, sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS tp FROM pc FULL JOIN gc USING ({keys}))
"""


_K4 = "run_id, head, relation, tail"
_REC = f"""
rec AS (SELECT (row_id % 13)::INT AS stop, trim(subject_label) AS head, predicate_label AS predicate, trim(object_label) AS tail, CASE WHEN confidence >= 0 THEN confidence END AS confidence, row_id AS ord,
  {_N3.format('subject_label')} AS h, {_N13.format('predicate_label')} AS p, {_N3.format('object_label')} AS t FROM kg WHERE subject_label IS NOT NULL AND predicate_label IS NOT NULL AND object_label IS NOT NULL)
"""
_CLUSTERS = f"""
WITH {_KG}, {_REC},
hl AS (SELECT h, p, t, head, row_number() OVER (PARTITION BY h, p, t ORDER BY count(*) DESC, length(head), lower(head), head) AS r FROM rec GROUP BY h, p, t, head),
tl AS (SELECT h, p, t, tail, row_number() OVER (PARTITION BY h, p, t ORDER BY count(*) DESC, length(tail), lower(tail), tail) AS r FROM rec GROUP BY h, p, t, tail),
cl AS (SELECT h, p, t, count(*) AS support, count(DISTINCT stop) AS layers, min(stop) AS first_seen, max(stop) AS last_seen, avg(confidence) AS confidence, min(ord) AS ord, list(DISTINCT stop) AS stops FROM rec GROUP BY 1, 2, 3)
"""
_MEMBERS = f"m AS (SELECT h || '|' || p || '|' || t AS cluster, stop FROM rec)"
_GENERIC = ["message", "alarm", "alarme", "operator", "system", "machine", "component", "condition", "action", "issue", "problem", "error", "warning", "fault"]


def _penalty(x: str) -> str:
    toks = f"list_distinct([w FOR w IN string_split({_N3.format(x)}, ' ') IF w <> ''])"
    hit = f"len(list_intersect({toks}, {_GENERIC}))"
    n = f"len([w FOR w IN string_split({_N3.format(x)}, ' ') IF w <> ''])"
    generic = f"CASE WHEN len({toks}) = 0 THEN 0.5 WHEN len({toks}) <= 2 AND {hit} > 0 THEN 0.35 WHEN {hit} = len({toks}) THEN 0.5 ELSE 0.0 END"
    return f"(0.35 * ({generic}) + 0.20 * (CASE WHEN {n} <= 8 THEN 0.0 ELSE least(1.0, ({n} - 8) / 20.0) END))"


_REL = "rel AS (SELECT run_id AS doc_id, element_id AS relation_id, label, trim(domain_hint) AS d, trim(range_hint) AS r, row_id AS ord, description FROM layer06_concept_relation_induction WHERE element_kind = 'relation' AND label IS NOT NULL)"
_LINK = f"""
con AS (SELECT run_id AS doc_id, element_id AS concept_id, label, domain_hint, row_id AS ord, description FROM layer06_concept_relation_induction WHERE element_kind = 'concept' AND label IS NOT NULL),
lk0 AS (SELECT doc_id, concept_id AS child_id, label AS child_label, 'ontology_parent_' || {_SLUG.format("domain_hint", "unknown")} AS parent_id, trim(domain_hint) AS parent_label, ord FROM con WHERE trim(coalesce(domain_hint, '')) <> '' AND lower(trim(label)) <> lower(trim(domain_hint))),
lk1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, child_id, parent_id ORDER BY ord, child_id) AS k FROM lk0) WHERE k = 1),
links AS (SELECT *, printf('concept_h_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY ord, child_id) - 1) AS link_id FROM lk1)
"""
_SCHEMA = f"""
WITH {_REL}, {_LINK},
rl AS (SELECT *, printf('relation_h_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY ord, relation_id) - 1) AS link_id FROM rel WHERE lower(trim(label)) <> 'object property'),
s0 AS (
  SELECT doc_id, 0 AS phase, ord, relation_id AS by_, 0 AS k, 'relation_domain' AS schema_type, relation_id AS subject_id, 'domain' AS predicate, d AS object_label FROM rel WHERE d <> ''
  UNION ALL SELECT doc_id, 0, ord, relation_id, 1, 'relation_range', relation_id, 'range', r FROM rel WHERE r <> ''
  UNION ALL SELECT doc_id, 1, ord, link_id, 0, 'subclass', child_id, 'subClassOf', parent_label FROM links
  UNION ALL SELECT doc_id, 2, ord, link_id, 0, 'subproperty', relation_id, 'subPropertyOf', 'Object Property' FROM rl),
schemata AS (SELECT *, printf('schema_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY phase, ord, by_, k) - 1) AS schema_id FROM s0)
"""
_TREE = "e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT up.node, e.parent, up.depth + 1 FROM up JOIN e ON up.ancestor = e.child)"
_RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_EDGES = f"e AS (SELECT {_N6.format('subject_label')} AS source, {_N6.format('object_label')} AS target FROM kg WHERE subject_label IS NOT NULL AND object_label IS NOT NULL), d AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY 1)"


def _triple_rows() -> str:
    iri = lambda kind, c: f"'http://example.org/resource/{kind}/' || regexp_replace(coalesce({c}, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g')"
    s, o, p, t = iri("node", "subject_id"), iri("node", "object_id"), iri("relation", "predicate_id"), iri("triple", "triple_id")
    rdf, rdfs = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
    base = "http://example.org/resource/"
    rows = [
        (s, p, o, "false"), (t, f"'{base}confidence'", "confidence::VARCHAR", "true"), (t, f"'{base}sourceChunk'", "chunk_id", "true"), (t, f"'{base}justification'", "justification", "true"),
        (s, f"'{rdfs}label'", "subject_label", "true"), (o, f"'{rdfs}label'", "object_label", "true"), (p, f"'{rdfs}label'", "predicate_label", "true"),
        (s, f"'{rdf}type'", iri("concept", "subject_type"), "false"), (o, f"'{rdf}type'", iri("concept", "object_type"), "false"),
        (t, f"'{rdf}type'", f"'{rdf}Statement'", "false"), (t, f"'{rdf}subject'", s, "false"), (t, f"'{rdf}predicate'", p, "false"), (t, f"'{rdf}object'", o, "false"),
    ]
    return " UNION ".join(f"SELECT {a} AS s, {b} AS p, {c} AS o, {d} AS o_is_literal FROM kg WHERE ({c}) IS NOT NULL" for a, b, c, d in rows)


ORACLE_SQL = {
    "resolve_candidates": f"WITH {_KG}, m AS (SELECT doc_id, coalesce(subject_type, 'entity') AS candidate_type, {_N4.format('subject_label')} AS normalized_label, subject_label AS label, CASE WHEN confidence >= 0 THEN confidence END AS c, row_id FROM kg WHERE subject_label IS NOT NULL), a AS (SELECT doc_id, candidate_type, normalized_label, round(avg(c), 6) AS confidence, count(*) AS n_mentions, min(row_id) AS ord FROM m WHERE normalized_label <> '' GROUP BY 1, 2, 3), l AS (SELECT doc_id, candidate_type, normalized_label, label AS canonical_label, row_number() OVER (PARTITION BY doc_id, candidate_type, normalized_label ORDER BY length(label), lower(label), label) AS r FROM m) SELECT doc_id, candidate_type, normalized_label, canonical_label, confidence, n_mentions, ord, printf('cand_%s_%05d', CASE candidate_type WHEN 'entity' THEN 'e' WHEN 'relation' THEN 'r' WHEN 'attribute' THEN 'v' ELSE 's' END, row_number() OVER (PARTITION BY doc_id, candidate_type ORDER BY ord, normalized_label) - 1) AS candidate_id FROM a JOIN l USING (doc_id, candidate_type, normalized_label) WHERE r = 1",
    "assertions_to_triples": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_candidate_id, relation_candidate_id, target_candidate_id, chunk_id ORDER BY row_id) AS r FROM layer04_candidate_relation_extraction) SELECT run_id, printf('triple_%05d', row_number() OVER (PARTITION BY run_id ORDER BY row_id) - 1) AS triple_id, row_id, source_candidate_id AS subject_id, relation_candidate_id AS predicate_id, target_candidate_id AS object_id, chunk_id FROM k WHERE r = 1",
    "records_to_triples": "WITH o AS (SELECT (o_custkey % 100) AS doc_id, 'order_' || o_orderkey AS chunk_id, o_orderkey::VARCHAR AS record_no, 'Order ' || o_orderkey AS label, trim(o_orderpriority) AS c, trim(o_orderstatus) AS e, trim(c_name) AS r FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT doc_id, chunk_id, record_no, 0 AS f, c AS s, 'TRIGGERS' AS p, label AS o FROM o UNION ALL SELECT doc_id, chunk_id, record_no, 1, label, 'CAUSES', e FROM o UNION ALL SELECT doc_id, chunk_id, record_no, 3, label, 'HANDLED_BY', r FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s), p, lower(o), record_no ORDER BY chunk_id, f, s, o) AS n FROM t) SELECT doc_id, chunk_id, s AS subject_label, p AS predicate_label, o AS object_label, printf('triple_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, record_no, f, s, o) - 1) AS triple_id FROM k WHERE n = 1",
    "duplicate_triples": f"SELECT run_id AS doc_id, row_id, triple_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, subject_id, predicate_id, object_id, chunk_id ORDER BY row_id) AS r FROM {_L5}) WHERE r > 1",
    "incomplete_triples": f"WITH {_KG} SELECT row_id, triple_id FROM kg WHERE coalesce(subject_id, '') = '' OR coalesce(predicate_id, '') = '' OR coalesce(object_id, '') = ''",
    "inferred_graph": f"WITH {_KG} SELECT doc_id, row_id, subject_id, predicate_id, object_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, subject_id, predicate_id, object_id, chunk_id ORDER BY row_id) AS r FROM kg) WHERE r = 1",
    "graph_completion": f"WITH {_KG} SELECT row_id, triple_id FROM kg WHERE NOT EXISTS (SELECT 1 FROM {_L5} l WHERE l.run_id = kg.run_id AND l.subject_id IS NOT DISTINCT FROM kg.subject_id AND l.predicate_id IS NOT DISTINCT FROM kg.predicate_id AND l.object_id IS NOT DISTINCT FROM kg.object_id AND l.chunk_id IS NOT DISTINCT FROM kg.chunk_id)",
    "parent_hierarchy": f"WITH {_LINK} SELECT doc_id, link_id, child_id, child_label, parent_id, parent_label FROM links",
    "axiom_schemata": _SCHEMA + "SELECT doc_id, schema_id, schema_type, subject_id, predicate, object_label FROM schemata",
    "general_axioms": _SCHEMA + ", a AS (SELECT DISTINCT doc_id, schema_type AS axiom_type, subject_id, predicate, object_label, NULL::VARCHAR AS literal_value, CASE WHEN schema_type IN ('relation_domain', 'relation_range') THEN '' WHEN schema_type = 'subproperty' THEN 'x' ELSE by_ END AS oid FROM (SELECT doc_id, schema_type, subject_id, predicate, object_label, CASE WHEN schema_type = 'subclass' THEN object_label ELSE by_ END AS by_ FROM schemata) UNION SELECT DISTINCT doc_id, 'description', concept_id, 'rdfs:description', NULL, coalesce(nullif(trim(description), ''), 'Ontology concept candidate representing ' || label || '.'), '' FROM con UNION SELECT DISTINCT doc_id, 'description', relation_id, 'rdfs:description', NULL, coalesce(nullif(trim(description), ''), 'Ontology relation candidate representing ' || label || '.'), '' FROM rel) SELECT axiom_type, predicate, count(*) AS n, count(DISTINCT doc_id) AS docs, count(literal_value) AS literals FROM a GROUP BY 1, 2",
    "domain_ranges": f"WITH {_REL} SELECT a.d AS domain, b.r AS range, count(*) AS n FROM rel a JOIN rel b ON a.doc_id = b.doc_id AND a.relation_id = b.relation_id WHERE a.d <> '' AND b.r <> '' GROUP BY 1, 2",
    "triples_per_candidate": f"WITH {_KG}, x AS (SELECT DISTINCT doc_id, triple_id, unnest([subject_id, predicate_id, object_id]) AS candidate_id FROM kg WHERE subject_id IS NOT NULL) SELECT doc_id, candidate_id, count(*)::INT AS n, string_agg(triple_id, ',' ORDER BY triple_id) AS triples FROM x WHERE candidate_id <> '' GROUP BY 1, 2",
    "concept_induction": f"WITH {_KG}, c AS (SELECT doc_id, subject_id, trim(subject_label) AS label, {_N4.format('trim(subject_label)')} AS nl, coalesce(subject_type, 'entity') AS parent_hint, row_id FROM kg WHERE subject_label IS NOT NULL AND subject_id IS NOT NULL AND trim(subject_label) <> ''), a AS (SELECT doc_id, nl, parent_hint, arg_min(label, row_id) AS label, count(*)::INT AS n, min(row_id) AS ord FROM c GROUP BY 1, 2, 3) SELECT doc_id, printf('concept_%05d', row_number() OVER (PARTITION BY doc_id ORDER BY ord, nl, parent_hint) - 1) AS concept_id, label, parent_hint, n FROM a",
    "prf_exact": f"WITH {_KG}, {_GP}, {_counts('p', 'g', _K4)} SELECT pred_n, gold_n, tp, {_PRF} FROM c",
    "prf_sets": f"WITH {_KG}, {_GP}, {_counts(f'(SELECT DISTINCT {_K4} FROM p)', f'(SELECT DISTINCT {_K4} FROM g)', _K4)} SELECT pred_n, gold_n, tp, {_PRF} FROM c",
    "prf_per_relation": f"WITH {_KG}, {_GP}, pc AS (SELECT {_K4}, count(*) AS p FROM p GROUP BY ALL), gc AS (SELECT {_K4}, count(*) AS g FROM g GROUP BY ALL), c AS (SELECT relation, sum(coalesce(p, 0))::BIGINT AS pred_n, sum(coalesce(g, 0))::BIGINT AS gold_n, sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS tp FROM pc FULL JOIN gc USING ({_K4}) GROUP BY ROLLUP (relation)) SELECT relation, pred_n AS pred_count, gold_n AS gold_count, tp, {_PRF} FROM c",
    "predicate_only": f"WITH {_KG}, {_GP}, p2 AS (SELECT DISTINCT translate(trim(lower(relation)), '_-', '  ') AS r FROM p WHERE trim(relation) <> ''), g2 AS (SELECT DISTINCT translate(trim(lower(relation)), '_-', '  ') AS r FROM g WHERE trim(relation) <> ''), c AS (SELECT (SELECT count(*) FROM p2) AS pred_n, (SELECT count(*) FROM g2) AS gold_n, (SELECT count(*) FROM p2 JOIN g2 USING (r)) AS tp) SELECT pred_n, gold_n, tp, {_PRF} FROM c",
    "validation_metrics": f"""WITH {_KG}, g AS (SELECT DISTINCT run_id, {_DOMAIN.format('subject_label')} AS h, upper({_DOMAIN.format('predicate_label')}) AS r, {_DOMAIN.format('object_label')} AS t FROM {_L5}),
        p AS (SELECT source_code, run_id, {_DOMAIN.format('subject_label')} AS h, upper({_DOMAIN.format('predicate_label')}) AS r, {_DOMAIN.format('object_label')} AS t, {_EVAL.format('subject_label')} AS eh, {_EVAL.format('object_label')} AS et,
          lower(trim(coalesce(subject_label, ''))) AS rh, lower(trim(coalesce(object_label, ''))) AS rt, upper(trim(coalesce(predicate_label, ''))) AS rr, trim(coalesce(justification, '')) <> '' AS prov FROM kg),
        f AS (SELECT *, EXISTS (SELECT 1 FROM g WHERE g.run_id = p.run_id AND g.h = p.h AND g.r = p.r AND g.t = p.t) AS sup, EXISTS (SELECT 1 FROM g WHERE g.run_id = p.run_id AND g.h = p.h AND g.r = p.r) AS half,
          regexp_matches(rh, '^(concept_|ont_rel_|cand_)') OR regexp_matches(rt, '^(concept_|ont_rel_|cand_)') AS mal, eh IN ('alarm', 'device', 'failure', 'part', 'machine', 'check') OR et IN ('alarm', 'device', 'failure', 'part', 'machine', 'check') AS gen FROM p),
        s AS (SELECT source_code, count(*) AS n, round(avg(sup::INT), 6) AS "STR", round(avg((half AND NOT sup)::INT), 6) AS "CR", round(avg(prov::INT), 6) AS "PC", round(avg((rr <> '' AND eh <> '' AND et <> '' AND NOT mal AND NOT gen)::INT), 6) AS "OC", round(avg((eh = '' OR et = '' OR eh = et OR gen OR mal)::INT), 6) AS "CV" FROM f GROUP BY 1)
        SELECT *, CASE WHEN "STR" >= 0.5 AND "CR" <= 0.2 AND "OC" >= 0.7 AND "CV" <= 0.3 THEN 1.0 ELSE 0.0 END::DOUBLE AS "DVS" FROM s""",
    "contradiction_pairs": f"WITH f AS (SELECT run_id, trim(lower(subject_label)) AS s, trim(lower(predicate_label)) AS p, trim(lower(object_label)) AS o, min(row_id) AS ord FROM {_L5} WHERE subject_label IS NOT NULL AND predicate_label IS NOT NULL AND object_label IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT a.run_id, a.ord AS first_ord, b.ord AS second_ord FROM f a JOIN f b ON a.run_id = b.run_id AND a.s = b.s AND a.p = b.p AND a.ord < b.ord",
    "faithfulness": f"WITH t AS (SELECT row_id, trim(lower(coalesce(subject_label, ''))) AS s, trim(lower(coalesce(object_label, ''))) AS o, coalesce(subject_label, '') <> '' AS hs, coalesce(object_label, '') <> '' AS ho, [trim(lower(e.snippet)) FOR e IN coalesce(provenance, []) IF trim(lower(e.snippet)) <> ''] AS n FROM {_L5}), f AS (SELECT row_id, len(n) > 0 AS has_provenance, hs AND len([x FOR x IN n IF contains(x, s)]) > 0 AS subject_grounded, ho AND len([x FOR x IN n IF contains(x, o)]) > 0 AS object_grounded FROM t) SELECT *, has_provenance AND subject_grounded AND object_grounded AS grounded FROM f",
    "best_evidence": f"WITH e AS (SELECT row_id, unnest(provenance) AS e FROM {_L5}), d AS (SELECT row_id, count(*)::INT AS n FROM (SELECT DISTINCT row_id, e.chunk_id, e.chunk_start_char, e.chunk_end_char, substr(e.snippet, 1, 120) FROM e WHERE e IS NOT NULL) GROUP BY 1) SELECT row_id, CASE WHEN provenance IS NULL THEN -1 ELSE coalesce(n, 0) END AS n FROM {_L5} LEFT JOIN d USING (row_id)",
    "hierarchy_closure": f"WITH RECURSIVE {_TREE} SELECT node, ancestor, min(depth)::INT AS depth FROM up GROUP BY 1, 2",
    "hierarchy_depth": f"WITH RECURSIVE {_TREE}, n AS (SELECT child AS node FROM e UNION SELECT parent FROM e) SELECT n.node, coalesce(max(depth), 0)::INT AS depth FROM n LEFT JOIN up USING (node) GROUP BY 1",
    "consolidate_exact": _CLUSTERS + "SELECT p AS predicate, head, tail, support, layers, first_seen, last_seen, ord FROM cl JOIN hl USING (h, p, t) JOIN tl USING (h, p, t) WHERE hl.r = 1 AND tl.r = 1",
    "cluster_topk": _CLUSTERS + f"SELECT ord, support, round(s, 6) AS score FROM (SELECT ord, support, 2.25 * layers / 13 + 1.10 * ln(1 + support) + 0.85 * (CASE WHEN list_contains(stops, 12) THEN 1.0 ELSE 0.5 + 0.5 * last_seen / 12 END) + 0.40 * coalesce(confidence, 0.5) - {_penalty('head')} - {_penalty('tail')} AS s FROM cl JOIN hl USING (h, p, t) JOIN tl USING (h, p, t) WHERE hl.r = 1 AND tl.r = 1) ORDER BY s DESC, support DESC, ord LIMIT 226",
    "layer_contribution": f"WITH {_KG}, {_REC}, {_MEMBERS}, d AS (SELECT DISTINCT cluster, stop FROM m), f AS (SELECT *, min(stop) OVER (PARTITION BY cluster) AS first FROM d), ref AS (SELECT DISTINCT {_N3.format('subject_label')} || '|' || {_N13.format('predicate_label')} || '|' || {_N3.format('object_label')} AS r FROM {_L5}), n AS (SELECT first AS stop, count(DISTINCT cluster) AS newly FROM f JOIN ref ON cluster = r GROUP BY 1), s AS (SELECT stop, count(*) FILTER (WHERE first = stop) AS new_clusters, count(*) FILTER (WHERE first < stop) AS reinforced FROM f GROUP BY 1) SELECT stop, new_clusters, reinforced, coalesce(newly, 0)::BIGINT AS newly_covered, (sum(coalesce(newly, 0)) OVER (ORDER BY stop))::BIGINT AS covered, (sum(new_clusters) OVER (ORDER BY stop))::BIGINT AS clusters FROM s LEFT JOIN n USING (stop)",
    "cluster_inventory": f"WITH {_KG}, {_REC}, {_MEMBERS} SELECT cluster, min(stop)::INT AS first, max(stop)::INT AS last, (max(stop) - min(stop) + 1)::INT AS span, count(DISTINCT stop) AS n_stops, string_agg(stop::VARCHAR, ',' ORDER BY stop) AS present FROM (SELECT DISTINCT cluster, stop FROM m) GROUP BY 1",
    "cumulative_prefixes": f"WITH {_KG}, {_REC}, s AS (SELECT DISTINCT stop AS prefix FROM rec) SELECT prefix, count(*) AS records, count(DISTINCT stop) AS stops FROM rec JOIN s ON stop <= prefix GROUP BY 1",
    "ablation_metrics": f"""WITH {_KG}, {_GP}, src AS (SELECT run_id, coalesce(source_code, '?') AS variant FROM run_manifest), a AS (SELECT variant, count(*) AS raw FROM p JOIN src USING (run_id) GROUP BY 1), b AS (SELECT variant, count(*) AS gold FROM (SELECT DISTINCT * FROM g) JOIN src USING (run_id) GROUP BY 1),
        c AS (SELECT variant, count(*) AS tp FROM (SELECT DISTINCT {_K4} FROM p INTERSECT SELECT DISTINCT {_K4} FROM g) JOIN src USING (run_id) GROUP BY 1), d AS (SELECT variant, coalesce(tp, 0) AS tp, coalesce(gold, 0) AS gold, coalesce(raw, 0) AS raw FROM a FULL JOIN b USING (variant) LEFT JOIN c USING (variant)),
        e AS (SELECT *, coalesce(tp / nullif(gold, 0), 0) AS c, coalesce(tp / nullif(raw, 0), 0) AS f FROM d) SELECT variant, tp, gold, raw, round(c, 6) AS coverage, round(f, 6) AS efficiency, round(CASE WHEN c > 0 AND f > 0 THEN 2 / (1 / c + 1 / f) ELSE 0 END, 6) AS coverage_efficiency, CASE WHEN tp > 0 THEN round(raw / tp, 6) END AS overgeneration,
        CASE WHEN tp > 0 THEN round(greatest(raw - tp, 0) / tp, 6) END AS excess_per_match, CASE WHEN raw > 0 THEN round(1 - f, 6) ELSE 0 END AS noise, CASE WHEN gold > 0 THEN round(1 - c, 6) ELSE 0 END AS miss_rate, round(coalesce(raw / nullif(gold, 0), 0), 6) AS triples_per_gold, round(100 * f, 6) AS matched_per_100 FROM e""",
    "closure_inverse": f"WITH {_KG}, t AS (SELECT subject_label AS head, predicate_label AS relation, object_label AS tail FROM kg WHERE doc_id IS NOT NULL AND subject_label IS NOT NULL AND predicate_label IS NOT NULL AND object_label IS NOT NULL), i AS (SELECT * FROM (VALUES ('part of', 'has part'), ('monitors', 'monitored by'), ('drives', 'driven by')) AS v(a, b)) SELECT DISTINCT tail AS head, b AS relation, head AS tail FROM t JOIN i ON relation = a EXCEPT SELECT * FROM t",
    "closure_two_hop": f"WITH {_KG}, t AS (SELECT concat_ws('/', doc_id, {_N3.format('subject_label')}) AS head, predicate_label AS relation, concat_ws('/', doc_id, {_N3.format('object_label')}) AS tail FROM kg WHERE predicate_label IS NOT NULL) SELECT DISTINCT a.head, 'located in' AS relation, b.tail FROM t a JOIN t b ON a.tail = b.head WHERE a.relation = 'part of' AND b.relation = 'located in' AND a.head <> b.tail EXCEPT SELECT * FROM t",
    "evidence_links": f"WITH {_KG}, m AS (SELECT DISTINCT doc_id, chunk_id AS w, unnest([{_N6.format('subject_label')}, {_N6.format('object_label')}]) AS e FROM kg WHERE chunk_id IS NOT NULL) SELECT doc_id, w AS \"window\", a, b FROM (SELECT x.doc_id, x.w, x.e AS a, y.e AS b, row_number() OVER (PARTITION BY x.doc_id, x.w, x.e ORDER BY y.e) AS r FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.w = y.w AND x.e <> y.e) WHERE r <= 16",
    "graph_degrees": f"WITH {_KG}, {_EDGES} SELECT * FROM d",
    "graph_root": f"WITH {_KG}, {_EDGES} SELECT node FROM d ORDER BY 3 * out_degree - 2 * in_degree + degree DESC, degree DESC, node DESC LIMIT 1",
    "graph_levels": f"WITH RECURSIVE {_KG}, {_EDGES}, x AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), b(node, level) AS (SELECT * FROM (SELECT node, 0 FROM d ORDER BY 3 * out_degree - 2 * in_degree + degree DESC, degree DESC, node DESC LIMIT 1) UNION SELECT x.b, level + 1 FROM b JOIN x ON x.a = b.node WHERE level < 60) SELECT node, min(level)::INT AS level FROM b GROUP BY 1",
    "turtle": f"WITH {_KG}, r AS ({_triple_rows()}), x AS (SELECT DISTINCT s, CASE WHEN p = '{_RDF_TYPE}' THEN 'a' ELSE '<' || p || '>' END || ' ' || CASE WHEN o_is_literal THEN '\"' || replace(replace(replace(replace(replace(o, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '\"' ELSE '<' || o || '>' END AS po FROM r) SELECT '<' || s || '> ' || string_agg(po, ' ;' || chr(10) || '    ' ORDER BY NOT starts_with(po, 'a '), po) || ' .' AS value FROM x GROUP BY s",
    "set_operations": f"WITH {_KG}, {_GP}, a AS (SELECT DISTINCT {_K4} FROM g), b AS (SELECT DISTINCT {_K4} FROM p) SELECT 'union' AS kind, run_id, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 2 UNION ALL SELECT 'intersect', run_id, count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 2 UNION ALL SELECT 'except', run_id, count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 2",
    "alias_labels": f"WITH {_KG}, a AS (SELECT {_N6.format('canon_label_fr')} AS k, arg_min(canon_label, canon_id) AS c FROM relation_catalog GROUP BY 1) SELECT row_id, coalesce(c, predicate_label) AS predicate_label FROM kg LEFT JOIN a ON k = {_N6.format('predicate_label')} WHERE predicate_label IS NOT NULL",
    "exact_counts": f"WITH {_KG}, {_GP}, a AS (SELECT {_K4}, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT {_K4}, count(*) AS n FROM p GROUP BY ALL) SELECT (SELECT sum(n) FROM b)::BIGINT AS pred_n, (SELECT sum(n) FROM a)::BIGINT AS gold_n, (SELECT coalesce(sum(least(a.n, b.n)), 0) FROM a JOIN b USING ({_K4}))::BIGINT AS tp",
    "role_typing": f"WITH {_KG}, t AS (SELECT row_id, {_WORDS.format('lower(' + _STRAIGHT.format('justification') + ')')} AS t FROM kg WHERE justification IS NOT NULL) SELECT row_id, concat_ws(',', CASE WHEN contains(t, 'alarm') OR contains(t, 'alarme') THEN 'alarm' END, CASE WHEN contains(t, 'filter') OR contains(t, 'motor') OR contains(t, 'valve') THEN 'part' END, CASE WHEN contains(t, 'record') OR contains(t, 'sheet') OR contains(t, 'row') THEN 'record' END) AS roles, CASE WHEN contains(t, 'because') OR contains(t, 'since') THEN 'CAUSES' WHEN contains(t, 'confirms') THEN 'CONFIRMS' WHEN contains(t, 'names') THEN 'NAMES' END AS relation FROM t",
    "located_snippets": f"WITH {_KG}, l AS (SELECT row_id, justification AS j, length(subject_label) AS n, CASE WHEN subject_label = '' THEN -1 ELSE strpos(lower(justification), lower(subject_label)) - 1 END AS s FROM kg WHERE justification IS NOT NULL AND subject_label IS NOT NULL) SELECT row_id, s::INT AS start, md5(CASE WHEN s >= 0 THEN trim(substr(j, greatest(s - 20, 0)::INT + 1, (s + n + 20 - greatest(s - 20, 0))::INT), ' ') ELSE '' END) AS digest FROM l",
    "confidence_edges": f"WITH {_KG}, e AS (SELECT {_N6.format('subject_label')} AS source, {_N6.format('object_label')} AS target, predicate_label AS label, coalesce(confidence, 1.0) AS confidence, row_id FROM kg WHERE subject_label IS NOT NULL AND object_label IS NOT NULL AND predicate_label IS NOT NULL) SELECT source, target, arg_max(label, row_id) AS label, arg_max(confidence, row_id) AS confidence FROM e WHERE confidence >= 0.5 GROUP BY 1, 2",
    "parsed_tuples": f"WITH {_KG}, t AS (SELECT row_id, string_split('(\"entity\"<|>' || subject_label || '<|>' || coalesce(subject_type, 'thing') || ')##(\"relationship\"<|>' || subject_label || '<|>' || object_label || ')', '##') AS r FROM kg WHERE subject_label IS NOT NULL AND object_label IS NOT NULL), u AS (SELECT row_id, generate_subscripts(r, 1) - 1 AS pos, unnest(r) AS r FROM t), v AS (SELECT row_id, pos, [regexp_replace(trim(x, ' '), '^\"|\"$', '', 'g') FOR x IN string_split(regexp_extract(r, '(?s)\\((.*)\\)', 1), '<|>')] AS f FROM u) SELECT row_id, pos::INT AS pos, lower(f[1]) AS kind, len(f[2:])::INT AS n_fields, md5(array_to_string(f[2:], '|')) AS digest FROM v WHERE lower(f[1]) IN ('entity', 'relationship')",
    "rdf_counts": f"WITH {_KG}, r AS ({_triple_rows()}) SELECT p, o_is_literal, count(*) AS n FROM r GROUP BY 1, 2",
    "label_sources": f"WITH {_KG}, x AS (SELECT {_N6.format('subject_label')} AS item, source_code, min(row_id) AS o FROM kg WHERE subject_label IS NOT NULL AND source_code IS NOT NULL GROUP BY 1, 2) SELECT item, string_agg(source_code, ',' ORDER BY o) AS sources FROM x GROUP BY 1",
    "label_diagnosis": f"WITH {_KG} SELECT relation, n, rank::INT AS rank FROM (SELECT predicate_label AS relation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, predicate_label) AS rank FROM kg WHERE predicate_label IS NOT NULL GROUP BY 1) WHERE rank <= 30",
    "id_overlap": f"WITH a AS (SELECT DISTINCT run_id FROM kg_inferred), b AS (SELECT DISTINCT run_id FROM {_L5}) SELECT (SELECT count(*) FROM a JOIN b USING (run_id)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (run_id)) AS only_first, (SELECT count(*) FROM b ANTI JOIN a USING (run_id)) AS only_second",
    "predicate_rules": f"WITH {_KG}, k AS (SELECT {_N13.format('predicate_label')} AS r, subject_type AS h, object_type AS t FROM kg), m AS (SELECT CASE WHEN r = '' THEN 'empty' WHEN r = 'HANDLED_BY' AND coalesce(NOT (h IN ('component', 'event', 'symptom') AND t IN ('person', 'organisation')), false) THEN 'type_mismatch' WHEN r = 'PROVOQUE' THEN 'translated' ELSE 'kept' END AS reason, r FROM k) SELECT CASE reason WHEN 'kept' THEN r WHEN 'translated' THEN 'CAUSES' END AS mapped, reason, count(*) AS n FROM m GROUP BY 1, 2",
    "panel_verdicts": f"WITH {_KG}, v AS (SELECT run_id || '/' || triple_id AS triple_id, confidence AS c FROM kg WHERE confidence >= 0), s AS (SELECT triple_id, count(*) AS judges, count(*) FILTER (WHERE c >= 0.7) AS yes, count(*) FILTER (WHERE c < 0.5) AS no, round(avg(c), 6) AS score FROM v GROUP BY 1) SELECT *, CASE WHEN yes > 0.5 * judges THEN 'correct' WHEN no > 0.5 * judges THEN 'incorrect' ELSE 'inconclusive' END AS verdict FROM s",
    "axiom_completion": "WITH a AS (SELECT run_id AS doc_id, rec_id, completed_axiom.axiom_type AS axiom_type, completed_axiom.subject_label AS subject_id, completed_axiom.predicate AS predicate, completed_axiom.object_label AS object_label, completed_axiom.literal_value AS literal_value FROM layer11_inference_completion WHERE completed_axiom IS NOT NULL) SELECT doc_id, min(rec_id) AS rec_id, axiom_type, subject_id, predicate, object_label, literal_value FROM a GROUP BY ALL",
    "top_orders": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
}
