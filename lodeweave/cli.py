"""Command line: ``python -m lodeweave.cli run|inspect|version``."""

from __future__ import annotations

import argparse
import json
import sys


def _spark(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodeweave")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="documents to a graph in a run directory")
    r.add_argument("documents", help="Parquet with doc_id and text")
    r.add_argument("lexicon", help="Parquet with term and label")
    r.add_argument("run_dir")
    i = sub.add_parser("inspect", help="status and files of a run")
    i.add_argument("run_dir")
    i.add_argument("--json", action="store_true")
    sub.add_parser("version")
    a = p.parse_args(args)
    if a.command == "version":
        from lodeweave import __version__

        print(__version__)
        return 0
    from lodeweave.operators.graph import kg_rdf
    from lodeweave.plans.pipeline import from_documents
    from lodeweave.sources.writers import Run, write_graph

    spark = _spark(f"lodeweave {a.command}")
    run = Run(spark, a.run_dir)
    if a.command == "inspect":
        files = run.files().orderBy("path")
        out = {"status": run.status(), "stages": run.done(), "files": files.count()}
        print(json.dumps(out) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
        return 0
    plan = from_documents(spark.read.parquet(a.documents), spark.read.parquet(a.lexicon))
    run.run(
        {
            "preprocessing": lambda _: {"chunks": plan["chunks"]}, "expressions": lambda _: {"expressions": plan["expressions"].drop("ord")}, "candidates": lambda _: {"candidates": plan["candidates"].drop("ord")},
            "triples": lambda _: {"triples": plan["triples"]},
        }
    )
    triples = run.load("triples", "triples")
    write_graph(triples.drop("provenance"), kg_rdf(triples), f"{run.path}/export")
    run.save("serialization", triples=triples)
    print(run.status())
    return 0


if __name__ == "__main__":
    sys.exit(main())
