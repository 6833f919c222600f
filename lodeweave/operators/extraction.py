"""Expressions, their enrichment, and their resolution into typed candidates (layers 1 to 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import by_alias, grouping, profile_key, spacing
from lodeweave.operators.keys import dedup_strings, keep_first
from lodeweave.session import rows_up_to

#: Field names of records and the roles they stand for.
ROLE_ALIASES = {
    "alarm_label": "alarm", "label": "alarm", "message_label": "message", "actor": "responsible", "responsible_actor": "responsible",
    "technical_reference": "reference", "ref": "reference", "action": "intervention", "corrective_action": "intervention",
}
#: Terms of a lexicon that are broadcast at most.
SMALL_LEXICON = 100_000
FIELDS = ("cause", "effect", "intervention", "responsible", "reference")


def locate(text: Column, expression: Column) -> Column:
    """Where an expression begins in a text, case apart; -1 if it does not occur or is empty."""
    return F.when(F.coalesce(expression, F.lit("")) == "", F.lit(-1)).otherwise(F.coalesce(F.position(F.lower(expression), F.lower(text)) - 1, F.lit(-1)))


def snippet(text: Column, start: Column, length: Column, around: int = 80) -> Column:
    """The text around a place; empty if it was not located."""
    begin = F.greatest(start - around, F.lit(0))
    return F.when(start >= 0, F.trim(text.substr((begin + 1).cast("int"), (start + length + around - begin).cast("int")))).otherwise("")


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_grams(w: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many words, joined by a blank; ``w`` should be a column, as it is read often."""
    none = F.array().cast("array<string>")
    runs = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(none) for n in lengths]
    return F.array_distinct(F.concat(none, *runs))


def word_lengths(terms: DataFrame, gram: str) -> list[int]:
    """The numbers of words that terms have; a few, as they are distinct."""
    n = F.size(F.split(gram, " "))
    return sorted(r[0] for r in terms.where(F.col(gram) != "").select(n).distinct().collect())


def lexicon_expressions(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries of a lexicon met in chunks, with evidence; the model-free extractor.

    ``chunks(doc_id, chunk_id, chunk, start_char)`` and ``lexicon(term, label)``. A chunk's runs of words, of
    the lengths that terms have, are joined with the terms' words by equality, so no text is compared with
    every term. A lexicon of at most ``SMALL_LEXICON`` terms is broadcast; with a larger one only the runs are
    shuffled, and the chunks' texts join the hits.
    """
    terms = lexicon.select(F.lower(F.trim("term")).alias("term"), F.array_join(words(F.trim("term")), " ").alias("g"), "label").distinct()
    lengths = word_lengths(terms, "g")
    if rows_up_to(terms, SMALL_LEXICON) is not None:
        hits = chunks.withColumn("w", words(F.col("chunk"))).withColumn("g", F.explode(word_grams(F.col("w"), lengths))).drop("w").join(F.broadcast(terms), "g").drop("g")
    else:
        keyed = chunks.withColumn("_key", F.xxhash64("doc_id", "chunk_id", "chunk"))
        grams = keyed.select("_key", words(F.col("chunk")).alias("w")).distinct().select("_key", F.explode(word_grams(F.col("w"), lengths)).alias("g"))
        hits = keyed.join(grams.join(terms, "g").drop("g").distinct(), "_key").drop("_key")
    at = locate(F.col("chunk"), F.col("term"))
    return hits.select(
        "doc_id", "chunk_id", F.col("term").alias("text"), "label", at.alias("chunk_start_char"),
        F.when(at >= 0, at + F.length("term")).otherwise(-1).alias("chunk_end_char"),
        F.when(at >= 0, F.col("start_char") + at).otherwise(-1).alias("doc_start_char"),
        F.when(at >= 0, F.col("start_char") + at + F.length("term")).otherwise(-1).alias("doc_end_char"),
        snippet(F.col("chunk"), at, F.length("term")).alias("snippet"),
    )


def dedup_expressions(expressions: DataFrame, order: list, scope: str = "document") -> DataFrame:
    """The first expression of each text and label in a document, or in each of its chunks."""
    keys = ["doc_id", *([] if scope == "document" else ["chunk_id"]), F.lower("text"), F.lower("label")]
    return keep_first(expressions, keys, order)


def record_id(metadata: Column, header: Column, text: Column, message: str = r"(?i)message\s*(?:no\.?|number|n°)?\s*[:#]?\s*(\d+)", alarm: str = r"(?i)alarm[e]?\s*(?:no\.?|number|n°)?\s*[:#]?\s*(\d+)") -> Column:
    """A record's type and number from its metadata, its beginning, or its whole text; messages before alarms."""
    hit = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    tries = [F.nullif(F.trim(metadata), F.lit("")), hit(header, message), hit(header, alarm), hit(text, message), hit(text, alarm)]
    kind = F.when(hit(header, message).isNotNull(), "message").when(hit(header, alarm).isNotNull(), "alarm").when(hit(text, message).isNotNull(), "message").when(hit(text, alarm).isNotNull(), "alarm").otherwise("unknown")
    return F.struct(kind.alias("record_type"), F.coalesce(*tries).alias("record_no"))


def records_from_fields(rows: DataFrame, aliases: dict[str, str], key: str = "chunk_id") -> DataFrame:
    """Records pivoted from ``(key, row, field, values)``: one array per known field."""
    role = by_alias(F.col("field"), aliases)
    ordered = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(role == name, F.struct("row", "values")))), lambda x: x["values"]))
    return rows.groupBy(key).agg(*[ordered(n).alias(f"{n}_items") for n in FIELDS], F.max(F.when(role == "text", F.element_at("values", 1))).alias("label"))


def split_responsible(text: Column) -> Column:
    """Several persons in one field, as an array."""
    return dedup_strings(F.split(text, r"\s*(?:/|;|\bet\b|\band\b)\s*"))


def canonical_values(values: Column, mapping: dict[str, str]) -> Column:
    """Values through a profile's map, each once."""
    if not mapping:
        return dedup_strings(values)
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)])
    return dedup_strings(F.transform(values, lambda x: F.coalesce(F.try_element_at(table, profile_key(x)), x)))


def record_items(records: DataFrame) -> DataFrame:
    """``(.., ord, text, label)``: a record's label and the items of its fields, in order."""
    one = lambda c, role: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"), F.lit(role).alias("label")))
    items = F.concat(F.array(F.struct(F.col("label").alias("text"), F.lit("alarm").alias("label"))), *[one(f"{f}_items", f) for f in FIELDS])
    keys = [c for c in records.columns if c in ("doc_id", "chunk_id", "record_id")]
    out = records.select(*keys, F.posexplode(items).alias("ord", "i")).select(*keys, "ord", F.trim("i.text").alias("text"), "i.label")
    return out.where("text <> ''")


def checked(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Adds ``parsed`` and ``error``: records that do not fit the schema become rows with an error, not failures."""
    out = df.withColumn("parsed", F.from_json(F.col(payload), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return out.withColumn("error", F.when(F.col("parsed").isNull() | F.col("parsed._bad").isNotNull(), "malformed")).withColumn("parsed", F.col("parsed").dropFields("_bad"))


def enrich(expressions: DataFrame, roles: DataFrame) -> DataFrame:
    """Aliases, their sources and ontology hints of expressions, from a table of roles.

    ``roles(label, class_label, class_uri, family, promote, definition)`` has one row per role.
    """
    hints = F.array(
        F.concat(F.lit("semantic_role:"), F.col("label")), F.concat(F.lit("candidate_family:"), F.col("family")), F.concat(F.lit("class_uri:"), F.col("class_uri")),
        F.concat(F.lit("promote_to_ontology:"), F.coalesce(F.col("promote"), F.lit(False)).cast("string")), F.concat(F.lit("definition:"), F.col("definition")), F.col("class_label"),
    )
    out = expressions.join(roles, "label", "left")
    aliases = F.array_distinct(F.array(F.col("text"), F.lower("text")))
    return (
        out.withColumn("aliases", aliases)
        .withColumn("alias_sources", F.map_from_arrays(aliases, F.transform(aliases, lambda a: F.array(F.lit("expression")))))
        .withColumn("ontology_hints", dedup_strings(hints))
    )


def merge_sources(found: DataFrame) -> DataFrame:
    """``(item, sources)``: where each item was found, each source once, from ``(item, source, ord)``."""
    s = F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"])
    return found.groupBy("item").agg(F.array_distinct(s).alias("sources"))


def looks_relational(text: Column, markers: list[str], suffixes: list[str], whole_words: bool = True) -> Column:
    """Whether a phrase looks like a relation: a marker word (or, as an option, a mere part of one) or a verb's ending."""
    words = F.split(F.lower(text), r"\s+")
    out = F.lit(False)
    for m in markers:
        out = out | (F.array_contains(words, m) if whole_words else F.contains(F.lower(text), F.lit(m)))
    return out | F.exists(words, lambda w: w.rlike("(" + "|".join(suffixes) + ")$"))


def resolve_candidates(mentions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Candidates from ``mentions(doc_id, candidate_type, label, confidence, ord, expr_id[, definition])``.

    Mentions of one type whose labels are equal after normalization are one candidate: the shortest
    label is canonical (then the first in the alphabet), the confidence is the mean, the definition the
    first there is, and ids count in the order of first mentions within the document and type.
    """
    m = mentions.withColumn("normalized_label", grouping(F.col("label"))).where("normalized_label <> ''")
    definition = [F.min_by("definition", F.when(F.col("definition").isNotNull(), F.col("ord"))).alias("definition")] if "definition" in mentions.columns else []
    out = m.groupBy(*keys, "candidate_type", "normalized_label").agg(
        F.min_by("label", F.struct(F.length("label"), F.lower("label"), F.col("label"))).alias("canonical_label"),
        F.avg("confidence").alias("confidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "expr_id"))), lambda x: x["expr_id"]).alias("expr_ids"),
        F.count("*").alias("n_mentions"),
        F.min("ord").alias("ord"),
        *definition,
    )
    letter = F.when(F.col("candidate_type") == "entity", "e").when(F.col("candidate_type") == "relation", "r").when(F.col("candidate_type") == "attribute", "v").otherwise("s")
    n = F.row_number().over(Window.partitionBy(*keys, "candidate_type").orderBy("ord", "normalized_label")) - 1
    return out.withColumn("candidate_id", F.format_string("cand_%s_%05d", letter, n))


def controlled_relations(candidates: DataFrame, allowed: list[str], docs: DataFrame) -> DataFrame:
    """Relation candidates for the allowed labels that a document's candidates lack; ids go on from the last one."""
    spark = candidates.sparkSession
    wanted = spark.createDataFrame([(i, a) for i, a in enumerate(allowed)], "k int, label string")
    rel = candidates.where("candidate_type = 'relation'")
    pairs = docs.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("label")) for i, a in enumerate(allowed)])).alias("x")).select("doc_id", "x.*") if allowed else wanted.select(F.lit(None).cast("string").alias("doc_id"), "k", "label").limit(0)
    new = pairs.withColumn("normalized_label", grouping(F.col("label"))).join(rel.select("doc_id", "normalized_label"), ["doc_id", "normalized_label"], "left_anti")
    start = rel.groupBy("doc_id").agg(F.count("*").alias("n0"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    return new.join(start, "doc_id", "left").select("doc_id", F.lit("relation").alias("candidate_type"), "normalized_label", F.col("label").alias("canonical_label"), F.format_string("cand_r_%05d", F.coalesce("n0", F.lit(0)) + n).alias("candidate_id"))


def alt_labels(preferred: Column, *groups: Column) -> Column:
    """Aliases, synonyms, variants and mentions other than the preferred label, each once whatever its case."""
    every = dedup_strings(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in groups]))
    start = F.array().cast("array<string>")
    once = F.aggregate(every, start, lambda acc, x: F.when(F.exists(acc, lambda y: spacing(y) == spacing(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.filter(once, lambda x: spacing(x) != spacing(preferred))
