"""Sinks: graphs as JSON, N-Triples and Turtle, restartable runs, integrity, reports."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.graph import ntriples, turtle

STAGES = (
    "preprocessing", "expressions", "enrichment", "candidates", "assertions", "triples", "induction", "hierarchy", "schemata", "axioms", "validation", "completion", "serialization",
)


def kg_json(triples: DataFrame, provenance: bool = True) -> DataFrame:
    """``(value)``: one JSON object per triple with nested subject, predicate and object."""
    node = lambda s: F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_label").alias("label"), *([F.col(f"{s}_type").alias("type")] if s != "predicate" else []))
    cols = ["triple_id", node("subject").alias("subject"), node("predicate").alias("predicate"), node("object").alias("object"), "chunk_id", "justification", "confidence"]
    return triples.select(F.to_json(F.struct(*cols, *(["provenance"] if provenance else []))).alias("value"))


def write_graph(triples: DataFrame, rdf: DataFrame, path: str) -> None:
    """JSON lines, N-Triples and Turtle under a path; each file set is committed as a whole."""
    kg_json(triples, "provenance" in triples.columns).write.mode("overwrite").text(f"{path}/kg_json")
    ntriples(rdf).write.mode("overwrite").text(f"{path}/kg_nt")
    turtle(rdf).write.mode("overwrite").text(f"{path}/kg_ttl")


def write_ontology(rdf: DataFrame, path: str) -> None:
    """The statements of an ontology (``graph.ontology_rdf``) as Turtle and N-Triples under a path."""
    ntriples(rdf).write.mode("overwrite").text(f"{path}/ontology_nt")
    turtle(rdf).write.mode("overwrite").text(f"{path}/ontology_ttl")


class Run:
    """A run directory: one table per stage and name, and a manifest that is written last.

    A stage counts as done when its manifest entry is there, so a run that died is taken up where it was.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, stage: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{stage}/{name}")
        entry = [(stage, json.dumps(sorted(tables)), datetime.now(UTC).isoformat())]
        self.spark.createDataFrame(entry, "stage string, tables string, at string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{stage}")

    def done(self) -> list[str]:
        try:
            names = {r[0] for r in self.spark.read.schema("stage string, tables string, at string").json(f"{self.path}/manifest/*").select("stage").collect()}  # one row per stage
        except Exception:
            return []
        return [s for s in STAGES if s in names]

    def load(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{stage}/{name}")

    def status(self) -> str:
        done = self.done()
        return "completed" if STAGES[-1] in done else "partial" if done else "empty"

    def files(self) -> DataFrame:
        """``(path, length, sha256)`` of everything in the run."""
        return file_hashes(self.spark, self.path)

    def run(self, steps: dict, first: str | None = None, last: str | None = None, skip: tuple[str, ...] = ()) -> list[str]:
        """Runs the stages ``{name: function(run) -> {table: DataFrame}}`` from one to another, without those skipped or done."""
        names = [s for s in STAGES if s in steps]
        lo = names.index(first) if first else 0
        hi = names.index(last) if last else len(names) - 1
        did, done = [], set() if first else set(self.done())
        for s in names[lo : hi + 1]:
            if s not in skip and s not in done:
                self.save(s, **steps[s](self))
                did.append(s)
        return did


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def directory_hash(hashes: DataFrame, root: str) -> DataFrame:
    """One hash of a directory: of its files' relative paths and hashes in order."""
    rel = F.regexp_replace("path", "^.*" + root.rstrip("/").split("/")[-1] + "/", "")
    rows = F.array_sort(F.collect_list(F.concat(rel, F.lit("\u0001"), F.col("sha256"))))
    return hashes.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("sha256"), F.count("*").alias("files"))


def flatten_row(df: DataFrame, sep: str = ".") -> DataFrame:
    """Structs as columns with dotted names, for CSV."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        cols = []
        for name, kind in df.dtypes:
            if kind.startswith("struct"):
                cols += [F.col(f"`{name}`.`{f}`").alias(f"{name}{sep}{f}") for f in df.schema[name].dataType.names]
            else:
                cols.append(F.col(f"`{name}`"))
        df = df.select(*cols)
    return df


def write_report(df: DataFrame, path: str) -> None:
    """One row of metrics as JSON and CSV."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    flatten_row(df).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result table as Markdown; a report shows at most ``most`` rows."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]])


def compare_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reports of several runs in one table, with the path each came from."""
    return spark.read.json([f"{p}/json" for p in paths]).withColumn("run", F.input_file_name())
