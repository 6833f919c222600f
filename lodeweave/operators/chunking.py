"""Texts and blocks cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.normalizers import slug


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 1500, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters that overlap; the last one reaches the end. Adds chunk_id, start_char, end_char, chunk.

    Null and empty texts give no chunk; an overlap that leaves no step forward is refused.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    out = df.withColumn("_s", starts).select("*", F.posexplode("_s").alias("_i", "start_char")).drop("_s")
    return (
        out.withColumn("end_char", F.least(F.col("start_char") + size, F.length(text)))
        .withColumn("chunk", F.col(text).substr(F.col("start_char") + 1, F.lit(size)))
        .withColumn("chunk_id", F.format_string("chunk_%04d", "_i"))
        .drop("_i")
    )


def token_chunks(df: DataFrame, text: str = "text", size: int = 600, overlap: int = 100) -> DataFrame:
    """The same over words separated by white space; adds chunk_no, chunk and n_tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    n = F.size("_w")
    out = df.withColumn("_w", words).where(n > 0)
    out = out.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).alias("chunk_no", "_s"))
    part = F.slice("_w", F.col("_s") + 1, F.lit(size))
    return out.withColumn("chunk", F.array_join(part, " ")).withColumn("n_tokens", F.size(part)).drop("_w", "_s")


def ordered_text(order: str, text: Column, sep: str = "\n\n") -> Column:
    """The texts of a group in their order, joined; empty ones left out."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), sep)


def block_text() -> Column:
    """The text of a text block, else the text of its table."""
    return F.when(F.col("type") == "text", F.coalesce("text", F.lit(""))).otherwise(F.coalesce("html_text", "text", F.lit("")))


def page_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk per page of a document; blocks of one page fit one task."""
    out = blocks.groupBy("doc_id", "page").agg(ordered_text("order", block_text()).alias("chunk"))
    return out.where("chunk <> ''").withColumn("chunk_id", F.format_string("page_%04d", "page"))


def subsection_chunks(blocks: DataFrame, number: str = r"(?i)alarm\s*(?:no\.?|number)?\s*[:#]?\s*(\d+)") -> DataFrame:
    """One chunk per document, section and subsection, named after the record number in its text if there is one."""
    out = blocks.groupBy("doc_id", "document_key", "section_key", "subsection_key").agg(ordered_text("order", block_text()).alias("chunk"), F.min("order").alias("ord"))
    no = F.nullif(F.regexp_extract("chunk", number, 1), F.lit(""))
    return out.where("chunk <> ''").withColumn("chunk_id", F.concat_ws("_", F.lit("sub"), F.coalesce(no, slug(F.coalesce("subsection_key", "section_key", "document_key")))))


def unique_ids(df: DataFrame, base: str, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Ids that repeat within a document get ``_02``, ``_03`` and so on."""
    n = F.row_number().over(Window.partitionBy("doc_id", base).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.format_string("%s_%02d", F.col(base), n)))


def running_offsets(df: DataFrame, text: str = "chunk", order: list[str] | None = None, gap: int = 2) -> DataFrame:
    """start_char and end_char of chunks laid one after the other with a gap."""
    w = Window.partitionBy("doc_id").orderBy(*(order or ["ord"])).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(text) + gap).over(w) - gap
    return df.withColumn("start_char", (end - F.length(text)).cast("bigint")).withColumn("end_char", end.cast("bigint"))


def choose_unit(df: DataFrame, preferred: str, fallbacks: list[str], unit: str = "chunk_type") -> DataFrame:
    """The chunks of the preferred kind in each document, else of the first other kind it has."""
    order = [preferred, *[f for f in fallbacks if f != preferred]]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(unit))
    best = df.where(rank > 0).groupBy("doc_id").agg(F.min(rank).alias("_best"))
    return df.join(best, "doc_id").where(rank == F.col("_best")).drop("_best")


def pack(text: Column, most: int = 4500) -> Column:
    """Sentences packed greedily into pieces of at most ``most`` characters; longer ones are cut hard."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\n{2,}", "\u0001"), "\u0001|(?<=[.!?])\\s+"), lambda s: F.trim(s) != "")
    hard = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0)), F.lit(most)), lambda i: s.substr(i + 1, F.lit(most)))))
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(F.length(last) + 1 + F.length(s) <= most, F.lit(False))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(hard, start, step)
