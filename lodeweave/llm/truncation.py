"""Texts cut off by field limits or in transfer.

From all texts a vocabulary is counted with the contexts in which sentences end: how often a pair
of words, in a sentence with a given beginning, is followed by a full stop and how often by another
word. The vocabulary's words and all their prefixes form a trie, kept as a table (one row per node),
so it grows with the cluster and not with a task. A text without a sentence's end is cut off if

* it ends in an ellipsis mark or in half a character,
* its last word is unknown and a proper prefix of known words, or, after the word before it, a
  proper prefix of a word known there,
* its length is the one at which its source's unended texts pile up (length evidence), or
* sentences that begin like its last one go on after its last words, as a rule.

Short notes and sentences that only lack the full stop end where others end, and are no cases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut, salted_join

TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*\)?|\d+(?:[./,-]\d+)*\)?|[.!?;:,](?=\s|$)|[.!?…]+", re.UNICODE)
STOPS = {".", "!", "?"}
MARKS = {";", ":", ","}
#: The text's end is a sentence's end, with closing quotes or brackets after it.
ENDED = r"[.!?][\"'»”’)\]]*\s*$"
BROKEN = r"(\x{FFFD}|…|\.\.\.|\[\.*|\[…)\]?\s*$"
#: Share of a source's unended texts, and least length, that make a length a limit.
PILE, LEAST_LIMIT = 0.15, 60
#: Sentences with a given beginning that end in a full stop, as a share of those left open, up to which they are a form without one.
FORM = 0.05


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as #, and marks; a full stop before a small letter is a mark like a comma."""
    out = []
    for m in TOKEN.finditer(text):
        t = m[0]
        if t in STOPS:
            rest = text[m.end() : m.end() + 4].lstrip()
            out.append("," if rest[:1].islower() else t)
        elif t[0].isdigit():
            out.append("#)" if t[-1] == ")" else "#")
        else:
            out.append(t.lower())
    return out


def contexts(toks: list[str]) -> Iterator[tuple[str, str, str, int]]:
    """``(begin, before, word, what follows)`` for each word: 0 another word, 1 a sentence's end, 2 the text's end.

    A full stop after a single letter or a clipped word, before a small word or a number, ends nothing.
    """
    words: list[str] = []
    n = len(toks)
    for i, t in enumerate(toks):
        if t in STOPS or t in MARKS or t[0] in ".…":
            continue
        words.append(t)
        begin = " ".join(words[:2])
        before = words[-2] if len(words) > 1 else "^"
        after = toks[i + 1] if i + 1 < n else None
        if after is None or i + 2 >= n and (len(after) > 1 and after[0] == "." or after[0] == "…"):
            yield begin, before, t, 2  # nothing is known of a word before an ellipsis mark either
        elif after in STOPS and (i + 2 >= n or not (len(t) == 1 and t.isalpha()) and t != "no" and toks[i + 2] != "#"):
            yield begin, before, t, 1
            words = []
        else:
            yield begin, before, t, 0


def context_counts(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """``(begin, before, word, goes_on, ends)`` over all texts, combined within a task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k[:3], n if k[3] == 0 else 0, n if k[3] == 1 else 0) for k, n in seen.items()], columns=["begin", "before", "word", "goes_on", "ends"])
            seen.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(c for c in contexts(tokens(text)) if c[3] < 2)
            if len(seen) > flush:
                yield rows()
        yield rows()

    raw = texts.select("text").mapInPandas(count, "begin string, before string, word string, goes_on bigint, ends bigint")
    return raw.groupBy("begin", "before", "word").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))


def prefix_trie(vocabulary: DataFrame) -> DataFrame:
    """``(prefix)``: every proper prefix of a known word, once."""
    plain = vocabulary.where("word rlike '^\\\\p{L}'").select(F.regexp_replace("word", r"\)$", "").alias("word"))
    return plain.select(F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("prefix"), "word").where("prefix <> word").select("prefix").distinct()


def last_contexts(texts: DataFrame) -> DataFrame:
    """Adds ``begin, before, word, dangling`` of the last word to texts without a sentence's end, and ``note`` (under three words)."""

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                toks = tokens(text)
                end = None
                for end in contexts(toks):
                    pass
                dangling = bool(toks) and toks[-1] in MARKS or bool(re.search(r"\w\s*[-–(/&]\s*$", text))
                out.append((*(end[:3] if end else (None, None, None)), dangling, sum(x[0].isalnum() or x[0] == "#" for x in toks) < 3))
            yield pdf.assign(**{c: [o[k] for o in out] for k, c in enumerate(("begin", "before", "word", "dangling", "note"))})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(last, f"{schema}, begin string, before string, word string, dangling boolean, note boolean")


def find_truncated(texts: DataFrame) -> DataFrame:
    """``texts(tbl, row_id, ev_pos, source_code, text)`` to the rows whose text was cut off.

    Null and blank texts are no cases. Every text counts towards the statistics.
    """
    texts = texts.where("trim(text) <> ''")
    stats = cut(context_counts(texts))
    open_ended = texts.where(~F.col("text").rlike(ENDED) | F.col("text").rlike(BROKEN))
    size = F.length("text")
    rows = cut(
        last_contexts(
            open_ended.select("tbl", "row_id", "ev_pos", "source_code", size.alias("size"), F.col("text").rlike(BROKEN).alias("broken"), F.col("text").alias("text"))
        ).drop("text")
    )
    spread = rows.groupBy("tbl", "source_code", "size").agg(F.count("*").alias("at"))
    per_source = spread.groupBy("tbl", "source_code").agg(F.sum("at").alias("all"))
    limits = spread.join(per_source.withColumnRenamed("source_code", "sc").withColumnRenamed("tbl", "tb"), (F.col("tbl") == F.col("tb")) & F.col("source_code").eqNullSafe(F.col("sc")))
    limits = limits.where((F.col("at") >= PILE * F.col("all")) & (F.col("at") >= 10) & (F.col("size") >= LEAST_LIMIT)).select("tb", "sc", F.col("size").alias("sz"), F.lit(True).alias("limit"))

    ends = rows.where("not broken").groupBy("begin", "before", "word").agg(F.count("*").alias("open"))
    vocabulary = stats.groupBy("word").agg(F.sum("goes_on").alias("w_on"), F.sum("ends").alias("w_end"))
    level = lambda *by: stats.groupBy(*by)
    two = level("before", "word").agg(F.sum("goes_on").alias("t_on"), F.sum("ends").alias("t_end"))
    begin_word = level("begin", "word").agg(F.sum("goes_on").alias("b_on"), F.sum("ends").alias("b_end"))
    begins = level("begin").agg(F.sum("ends").alias("g_end"))
    opens = ends.groupBy("begin").agg(F.sum("open").alias("g_open"))
    alike = ends.groupBy("before", "word").agg(F.count("*").alias("n_begins"), F.sum("open").alias("t_open"))
    known = (
        ends.join(stats, ["begin", "before", "word"], "left")
        .join(two, ["before", "word"], "left")
        .join(begin_word, ["begin", "word"], "left")
        .join(begins, "begin", "left")
        .join(opens, "begin", "left")
        .join(alike, ["before", "word"], "left")
        .join(vocabulary, "word", "left")
        .join(prefix_trie(vocabulary).withColumn("is_prefix", F.lit(True)), F.col("word") == F.col("prefix"), "left")
    )
    pairs = two.where("word not like '#%' and before <> '^'").select("before", F.explode(F.expr("transform(sequence(1, greatest(length(word) - 1, 1)), i -> substring(word, 1, i))")).alias("word"), F.col("word").alias("whole"))
    begun = pairs.where("word <> whole").select("before", "word").distinct().withColumn("begun", F.lit(True))
    known = known.join(begun, ["before", "word"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    goes_on = lambda on, end: n(on) > n(end)
    # a form that never has a full stop ("Heading 5: ...") is complete where many of its texts end
    unknown = (n("w_on") + n("w_end") == 0) & F.coalesce(F.col("is_prefix"), F.lit(False))
    verdict = (
        F.when(unknown, True)
        .when((n("t_on") + n("t_end") == 0) & F.coalesce("begun", F.lit(False)), True)
        .when((n("g_end") <= FORM * n("g_open")) & (n("g_open") >= 5), n("goes_on") > 4 * F.col("open"))
        .when(n("goes_on") + n("ends") >= 2, goes_on("goes_on", "ends"))
        .when((n("t_on") + n("t_end") == 0) & (n("t_open") >= 5) & (n("n_begins") >= 3), False)
        .when((n("b_on") + n("b_end") >= 3) & ~F.col("word").startswith("#"), goes_on("b_on", "b_end"))
        .when((n("t_on") >= 20) & (n("t_end") < 0.01 * n("t_on")) & ((n("g_end") > 0) | (n("g_open") < 5)), True)
        .when(n("g_end") < 0.25 * n("g_open"), False)
        .when(n("t_on") + n("t_end") >= 2, goes_on("t_on", "t_end"))
        .when(n("w_on") + n("w_end") > 0, goes_on("w_on", "w_end"))
        .otherwise(n("g_end") > 0)
    )
    judged = known.select("begin", "before", "word", verdict.alias("verdict"), (unknown & (F.length("word") > 1)).alias("unknown"))
    flagged = salted_join(rows, judged, ["begin", "before", "word"], F.struct("row_id", "ev_pos"), ends.withColumnRenamed("open", "n"), how="left")
    flagged = flagged.join(limits, (F.col("tbl") == F.col("tb")) & F.col("source_code").eqNullSafe(F.col("sc")) & (F.col("size") == F.col("sz")), "left")
    cut_off = F.col("broken") | F.col("dangling") | F.coalesce("limit", F.lit(False)) | F.coalesce("verdict", F.lit(False)) & (~F.col("note") | F.col("unknown"))
    return flagged.where(cut_off).select("tbl", "row_id", "ev_pos", "source_code")
