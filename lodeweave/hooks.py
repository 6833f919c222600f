"""Model calls as pluggable functions with an offline default that gives the same answer every time.

A hook takes prompts (a pandas Series of text) and gives answers; it runs as an Arrow function on
batches. A failure of one prompt becomes an answer with an ``error``, never a failed job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Hook = Callable[[pd.Series], pd.Series]
#: What each stage's answer looks like when no model is there.
DEFAULTS: dict[str, dict] = {
    "expressions": {"expressions": []}, "enrichment": {"aliases": [], "synonyms": [], "lexical_variants": [], "definition": None, "ontology_hints": []},
    "typing": {"candidate_type": "entity", "canonical_label": None, "justification": "", "confidence": 0.5}, "relation": {"found": False, "source_candidate_id": None, "target_candidate_id": None, "justification": "", "confidence": None},
    "concept": {"promote": False, "label": None, "description": None, "confidence": None}, "hierarchy": {"is_subclass": False, "justification": "", "confidence": None},
    "schema": {"emit_domain_schema": False, "emit_range_schema": False}, "axiom": {"emit_axiom": False}, "grounding": {"grounding_summary": "", "merged_context": ""},
    "judge": {"score": 0.0, "verdict": "inconclusive", "rationale": ""}, "translation": {},
}


def offline(stage: str) -> Hook:
    answer = json.dumps(DEFAULTS.get(stage, {}), sort_keys=True)
    return lambda prompts: pd.Series([None if p is None else answer for p in prompts], dtype=object)


def echo(prompts: pd.Series) -> pd.Series:
    """The translation that changes nothing."""
    return prompts


class Hooks:
    """The model calls of a run, by stage."""

    def __init__(self, **hooks: Hook) -> None:
        self._hooks = dict(hooks)

    def column(self, stage: str, prompt: Column, retries: int = 2, wait: float = 0.0) -> Column:
        hook = self._hooks.get(stage) or offline(stage)

        def failed(x: Exception) -> str:
            return json.dumps({"error": str(x)[:500]})

        def alone(text: str) -> str:
            for attempt in range(retries + 1):
                try:
                    return hook(pd.Series([text])).iloc[0]
                except Exception as x:  # a model's failure is data
                    error = failed(x)
                    if attempt < retries and wait:
                        time.sleep(wait)
            return error

        @F.pandas_udf(T.StringType())
        def call(prompts: pd.Series) -> pd.Series:
            try:
                return hook(prompts)
            except Exception:  # find out which prompt it was; the others get their answers
                return prompts.map(alone).astype(object)

        return call(prompt)

    def has_model(self, stage: str) -> bool:
        return stage in self._hooks


def render(template: str, **values: Column) -> Column:
    """A prompt with ``$name`` replaced; names without a value stay as they are."""
    out = F.lit(template)
    for k in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${k}"), F.coalesce(values[k].cast("string"), F.lit("")))
    return out


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def prompt_statistics(prompts, by: list[str]):
    """Number, total, greatest and mean length of prompts."""
    n = F.length("prompt")
    return prompts.groupBy(*by).agg(F.count("*").alias("prompts"), F.sum(n).alias("chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.sum(token_estimate(F.col("prompt"))).alias("tokens"))
