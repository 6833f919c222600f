"""Order-dependent semantics on unordered data: keep-first and dense ids with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key by an order; nulls in keys are equal to each other.

    An aggregate, not a window: rows of a key are combined before the shuffle, so a key that holds a
    third of the rows is no hot spot. Of rows equal in the order the least as a whole stays.
    """
    cols = df.columns
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(c) for c in cols])
    first = F.struct(*[(o if isinstance(o, Column) else F.col(o)).alias(f"_o{i}") for i, o in enumerate(order)])
    kept = df.select(*named, first.alias("_first"), row.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_first").alias("_row"))
    return kept.select("_row.*")


def dense_id(df: DataFrame, name: str, prefix: str, order: list[str | Column], by: list[str] | None = None, width: int = 5, start: int = 0) -> DataFrame:
    """Sequential zero-padded ids from ``start`` within each value of ``by`` (a document; never a whole corpus)."""
    w = Window.partitionBy(*(by or ["doc_id"])).orderBy(*order)
    return df.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.row_number().over(w) - 1 + start))


def dedup_strings(values: Column) -> Column:
    """Trimmed strings that are not empty, each once, in the order met."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def dedup_evidence(evidence: Column) -> Column:
    """Evidence once per chunk, place and first 120 characters of the snippet; the first stays."""

    def same(a: Column, b: Column) -> Column:
        return (
            a["chunk_id"].eqNullSafe(b["chunk_id"]) & a["chunk_start_char"].eqNullSafe(b["chunk_start_char"]) & a["chunk_end_char"].eqNullSafe(b["chunk_end_char"])
            & F.substring(a["snippet"], 1, 120).eqNullSafe(F.substring(b["snippet"], 1, 120))
        )

    empty = F.filter(evidence, lambda e: F.lit(False))
    return F.aggregate(evidence, empty, lambda acc, e: F.when(e.isNull() | F.exists(acc, lambda x: same(x, e)), acc).otherwise(F.concat(acc, F.array(e))))


def append_new(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``old``; nulls are equal to each other."""
    left, right = new.alias("l"), old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().alias("r")
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return left.join(right, on, "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not among those already processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def replay(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Only the rows that a manifest names as failed."""
    return rows.join(failed.select(key).distinct(), key, "left_semi")
