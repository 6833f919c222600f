"""Free-typed labels mapped to the entries of a reference list.

Every entry is put into a trie under its own label, its French alias and, as further alias paths, the
forms without vowels ("dtcts"); clipped words ("manufact. by") follow the trie's branches to the ends of
the words they begin. A label is searched in the trie with a Levenshtein automaton, and all entries
within a distance that depends on its length come out (``near_entries``).

What tools and people put before and after a label ("rel:", "probably") is learned from the labels: words
that stand before, or after, several entries written out are decoration, apart from negations, and a
label is also searched without them. Labels for which no entry, or several equally near ones, are
found are reported with -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.trie import Trie
from lodeweave.session import cut, salted_join

#: Entries of the reference list that one task's trie holds; a longer list is taken in blocks.
BLOCK = 5000
#: Words before or after an entry are decoration if they are seen with so many entries; words of a decoration at most.
SUPPORT, LONGEST = 3, 3
#: Words that change a label's meaning are none.
NEGATIONS = {"not", "no", "non", "never", "without", "un", "ne", "pas", "sans", "jamais", "kein", "nicht", "ohne"}
VOWELS = set("aeiouy")
#: Costs nearer than this to the best one are as near.
TIE = 0.2
NEAR = "label string, entries array<struct<cost:double,canon_id:bigint>>"


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def words_of(label: str) -> list[tuple[str, bool]]:
    """The words of a label, split at case changes, each with a mark if a full stop follows it."""
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])", " ", unicodedata.normalize("NFC", label))
    return [(fold(m[1]), m[2] == ".") for m in re.finditer(r"([^\W_]+(?:['’][^\W_]+)*)(\.?)", text)]


def without_vowels(word: str) -> str:
    """What is left when vowels after the first letter are dropped."""
    return word[:1] + "".join(c for c in word[1:] if c not in VOWELS)


def budget(length: int) -> int:
    """Edits allowed in a text of so many characters."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 14 else 3 if length < 22 else 4


class Catalog:
    """The reference list as tries; ``leading`` and ``trailing`` are decorations, as tuples of words."""

    def __init__(self, entries: list[tuple[int, str | None, str | None]], leading: set[tuple[str, ...]] = frozenset(), trailing: set[tuple[str, ...]] = frozenset()) -> None:
        self.full, self.bare, self.spaced = Trie(), Trie(), Trie()
        self.leading, self.trailing = leading, trailing
        self.glued = {"".join(x) for x in leading}
        for canon, *labels in entries:
            for label in labels:
                words = tuple(w for w, _ in words_of(label or ""))
                if not words:
                    continue
                for path in {" ".join(words), " ".join(w.replace("'", "").replace("’", "") for w in words)}:
                    self.full.add(path.replace(" ", ""), canon)
                    self.spaced.add(path, canon)
                self.bare.add("".join(without_vowels(w) for w in words), canon)
                self.bare.add("".join(c for w in words for c in w if c not in VOWELS), canon)

    def near(self, typed: list[tuple[str, bool]]) -> dict[int, float]:
        """Cost by entry, for all entries within the distance."""
        words = [w for w, _ in typed]
        text = "".join(words).replace("'", "").replace("’", "")
        if not text:
            return {}
        out: dict[int, float] = dict.fromkeys(self.spaced.abbreviated(typed), 0.4)
        for d, canon in self.full.within(text, budget(len(text))):
            out[canon] = min(out.get(canon, 9.0), d + 0.0)
        if sum(c in VOWELS for c in text[1:]) <= max(1, len(text) // 6):
            bare = "".join(without_vowels(w) for w in words)
            for path in {text, bare}:
                for canon in self.bare.exact(path):
                    out[canon] = min(out.get(canon, 9.0), 0.3)
                if len(path) >= 6:
                    for d, canon in self.bare.within(path, 1):
                        out[canon] = min(out.get(canon, 9.0), d + 0.7)
        return out

    def forms(self, typed: list[tuple[str, bool]]) -> list[list[tuple[str, bool]]]:
        """A label as it stands and without its decorations, nearest to it first."""
        out = [typed]
        words = lambda f: tuple(w for w, _ in f)
        for f in out:  # grows as it is read
            shorter = [f[n:] for n in range(1, min(LONGEST, len(f) - 1) + 1) if words(f[:n]) in self.leading]
            shorter += [f[:-n] for n in range(1, min(LONGEST, len(f) - 1) + 1) if words(f[-n:]) in self.trailing]
            out += [x for x in shorter if x not in out]
        if typed:
            first, dot = typed[0]
            out += [[(first[n:], dot), *typed[1:]] for n in range(1, len(first) - 3) if first[:n] in self.glued]
        return out

    def lookup(self, label: str) -> tuple[list[tuple[float, int]], int]:
        """All near entries, nearest first, and the one meant (-1: none, or several equally near)."""
        best: dict[int, float] = {}
        for k, form in enumerate(self.forms(words_of(label))):
            for canon, cost in self.near(form).items():
                best[canon] = min(best.get(canon, 99.0), cost + 0.01 * k)
        ranked = sorted((cost, canon) for canon, cost in best.items())
        return ranked, ranked[0][1] if ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= TIE) else -1

    def decorations(self, label: str) -> list[tuple[str, str, int]]:
        """``(side, words, entry)`` for each way to read the label as an entry written out with words before or after it."""
        words = [w for w, _ in words_of(label)]
        if not words or self.full.exact("".join(words)):
            return []
        out = []
        for n in range(1, min(LONGEST, len(words) - 1) + 1):
            for side, own, rest in (("leading", words[:n], words[n:]), ("trailing", words[-n:], words[:-n])):
                if not NEGATIONS & set(own):
                    out += [(side, " ".join(own), canon) for canon in self.full.exact("".join(rest))]
        return out


def _blocks(catalog: DataFrame, block: int) -> list[list[tuple]]:
    """The list in parts of at most about ``block`` entries; the driver holds the list as broadcast, never more than it."""
    entries = catalog.select("canon_id", "canon_label", "canon_label_fr")
    n = -(-entries.count() // block)
    return [[tuple(r) for r in entries.where(F.pmod(F.xxhash64("canon_id"), F.lit(n)) == i).collect()] for i in range(n)]


def _spread(labels: DataFrame) -> DataFrame:
    """Labels in as many tasks as a shuffle has, whatever their size: a search takes long for its few bytes."""
    return labels.select("label").repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("label", F.lit(1)))


def decorations(labels: DataFrame, blocks: list[list[tuple]], support: int = SUPPORT) -> dict[str, set[tuple[str, ...]]]:
    """The leading and trailing words that stand beside at least ``support`` entries in labels; far fewer than the labels."""
    found = None
    for rows in blocks:

        def look(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            tries = Catalog(rows)
            for pdf in batches:
                yield pd.DataFrame([x for label in pdf["label"] if label for x in tries.decorations(label)], columns=["side", "words", "canon_id"])

        one = labels.mapInPandas(look, "side string, words string, canon_id bigint")
        found = one if found is None else found.unionByName(one)
    out: dict[str, set[tuple[str, ...]]] = {"leading": set(), "trailing": set()}
    if found is not None:
        for r in found.groupBy("side", "words").agg(F.count_distinct("canon_id").alias("n")).where(F.col("n") >= support).collect():
            out[r["side"]].add(tuple(r["words"].split(" ")))
    return out


def near_entries(labels: DataFrame, catalog: DataFrame, block: int = BLOCK) -> DataFrame:
    """``labels(label)``, one row each, to ``(label, entries)``: all entries within the distance, nearest first.

    The list is taken in blocks of about ``block`` entries, so no task holds more of it than that;
    what each block finds is brought together by label. Null and empty labels have no entries.
    """
    spark = labels.sparkSession
    blocks = _blocks(catalog, block)
    if not blocks:
        return labels.select("label", F.from_json(F.lit("[]"), "array<struct<cost:double,canon_id:bigint>>").alias("entries"))
    spread = cut(_spread(labels))
    known = decorations(spread, blocks)
    found = None
    for rows in blocks:
        shared = spark.sparkContext.broadcast((rows, known["leading"], known["trailing"]))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tries = Catalog(*shared.value)
            for pdf in batches:
                yield pd.DataFrame({"label": pdf["label"], "entries": [[{"cost": c, "canon_id": e} for c, e in tries.lookup(x)[0]] if x else [] for x in pdf["label"]]})

        one = spread.mapInPandas(search, NEAR)
        found = one if found is None else found.unionByName(one)
    if len(blocks) == 1:
        return found
    return found.groupBy("label").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))  # as many as are near


def map_labels(labels: DataFrame, catalog: DataFrame, block: int = BLOCK) -> DataFrame:
    """``labels(label)``, one row each, to ``(label, canon_id, cost)``; -1 where no entry is meant or several are as near."""
    best, second = F.try_element_at("entries", F.lit(1)), F.try_element_at("entries", F.lit(2))
    one = F.when(best.isNotNull() & (second.isNull() | (second["cost"] - best["cost"] >= TIE)), best["canon_id"])
    return near_entries(labels, catalog, block).select("label", F.coalesce(one, F.lit(-1)).cast("bigint").alias("canon_id"), best["cost"].alias("cost"))


def map_rows(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rows(tbl, row_id, label)`` to ``(tbl, row_id, canon_id)`` for labels not spelt as in the list.

    Each distinct label is searched once (counts are combined before the shuffle); the rows then
    join the answers, hot labels salted, as one may hold a third of them. Null labels are left out.
    """
    spelt = catalog.select(F.col("canon_label").alias("label")).where("label is not null").distinct()
    other = rows.select("tbl", "row_id", "label").where(F.col("label").isNotNull()).join(spelt, "label", "left_anti")
    counts = cut(other.groupBy("label").agg(F.count("*").alias("n")))
    answers = map_labels(counts.select("label"), catalog).select("label", "canon_id")
    return salted_join(other, answers, ["label"], F.struct("tbl", "row_id"), counts).select("tbl", "row_id", "canon_id")
