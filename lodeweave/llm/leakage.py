"""Passages of evaluation items found in a training corpus, whole or in part.

Latent semantic retrieval: the passages are cut into overlapping windows, whose word trigrams,
weighted by TF-IDF, form a sparse matrix. A randomised SVD, computed over distributed rows and
columns, gives each trigram a short vector. The corpus is read and tokenised once, without a
shuffle, whatever the number of items: each document's windows are projected with these vectors and
compared by cosine with the windows of the passages, one block of the stated query set after the
other. Each candidate is then aligned with the passage by a longest common subsequence, and counts
if at least half of the passage's words stand in one stretch with at most one word in ten changed.

The width of the windows follows the stretch that a passage needs (``SEARCHES``), so short passages
are found as well. A passage of three or four words needs three of them in a row; one of fewer
words matches nothing. Null, empty and contentless texts hold nothing. Texts are read whole,
whatever their length. Several copies of a text are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the passages in one block of the query set; it bounds what the driver and a task hold of them at a time.
BLOCK_WORDS = 150_000
#: Windows of a passage at most (they lie further apart in long ones), rank of the latent space, oversampling.
MOST_WINDOWS, RANK, OVER = 128, 96, 16
#: Share of a passage that makes a leak, and share of its words that may be changed.
STRETCH, CHANGED = 0.5, 0.1


@dataclass(frozen=True)
class Search:
    """Windows for passages that need a stretch of at least ``need`` words: their width and steps in words, the least share
    of known trigrams (by weight) of a document's window, and the least cosine."""

    need: int
    width: int
    step_passage: int
    step_doc: int
    known: float
    cosine: float


#: The shares are what a window that meets a stretch of the least length, with one word in ten changed, at the least favourable
#: place still has; the cosines lie below the least seen in such stretches of the evaluation items (0.92). In a stretch of under
#: ten words none may be changed.
SEARCHES = (Search(20, 20, 4, 6, 0.5, 0.85), Search(10, 10, 2, 3, 0.4, 0.75), Search(5, 5, 1, 1, 0.999, 0.7), Search(4, 4, 1, 1, 0.999, 0.7), Search(3, 3, 1, 1, 0.999, 0.7))

_BREAK = re.compile(r"(?<=\w)[-‐¬]\s*\n\s*(?:[>|*#]+\s*)?(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_GONE = re.compile("[­​‌‍⁠﻿]")


def words(text: str) -> list[str]:
    """The words of a text in lower case; words broken over two lines are joined, invisible marks dropped."""
    t = text.lower()
    if not t.isascii():
        t = _GONE.sub("", t)
    if "\n" in t:
        t = _BREAK.sub("", t)
    return _WORD.findall(t)


def lcs_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists as pairs of positions; one bit vector per row of ``a``."""
    masks: dict[int, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [], len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        before = rows[i - 1] if i else full
        while j >= 0 and rows[i] >> j & 1:  # a set bit: the length does not grow at j
            j -= 1
        if j < 0:
            break
        if before >> j & 1:  # it does not grow there without a[i] either, so a[i] is matched at j
            out.append((i, j))
            j -= 1
    return out[::-1]


def needed(n: int, stretch: float = STRETCH) -> int:
    """The words of a passage of ``n`` that must stand in one stretch."""
    return max(3, int(-(-n * stretch // 1)))


def leaks(passage: list[int], region: list[int], stretch: float = STRETCH, changed: float = CHANGED) -> bool:
    """Whether the region holds a stretch of the passage of the length wanted with few enough changes.

    Changed are words of the stretch that are missing, or words put between them, whichever are more.
    """
    need = needed(len(passage), stretch)
    runs = {tuple(passage[i : i + need]) for i in range(len(passage) - need + 1)}
    if any(tuple(region[i : i + need]) in runs for i in range(len(region) - need + 1)):
        return True
    pairs = lcs_pairs(passage, region)
    m = len(pairs)
    if m < need * (1 - changed):
        return False
    e = 0
    for s in range(m):
        e = max(e, s)
        # widen while the span stays good enough to matter; spans are checked from long to short
        for t in range(m - 1, s - 1, -1):
            span = pairs[t][0] - pairs[s][0] + 1
            count = t - s + 1
            if count + 0.1 * span + 1 < need * (1 - changed):
                break
            wide = max(span, pairs[t][1] - pairs[s][1] + 1)
            allowed = int(changed * max(span, need) + 1e-9)
            missing = wide - count
            # the stretch may reach past its first and last matched word, if those next to them are changed
            edge = max(0, need - span)
            if missing + edge <= allowed:
                return True
    return False


class Index:
    """The windows of some passages in a latent space, for one way to search."""

    def __init__(self, items: list[tuple[int, list[str]]], search: Search = SEARCHES[0]) -> None:
        self.search, self.items, self.passages = search, [], []
        self.ids: dict[str, int] = {}
        for item, w in items:
            self.items.append(item)
            self.passages.append([self.ids.setdefault(x, len(self.ids) + 1) for x in w])
        self.base = len(self.ids) + 1
        keys, of_item = [], []
        for k, p in enumerate(self.passages):
            g = self.grams(np.asarray(p, dtype=np.int64))
            step = max(search.step_passage, len(p) // MOST_WINDOWS)
            for s in range(0, max(1, len(p) - search.width + step), step):
                keys.append(g[s : s + search.width - 2])
                of_item.append(k)
        self.of_item = np.asarray(of_item)
        self.windows = keys
        flat = np.concatenate([np.unique(x) for x in keys]) if keys else np.zeros(0, np.int64)
        self.terms, df = np.unique(flat, return_counts=True)
        self.idf = np.log(1.0 + len(keys) / df).astype(np.float32) if len(df) else np.zeros(0, np.float32)
        self.most = float(np.median(self.idf)) if len(self.idf) else 1.0  # an unknown trigram weighs as much as an ordinary one

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the word trigrams; 0 where a word is unknown."""
        if len(ids) < 3:
            return np.zeros(0, np.int64)
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        key = (a * self.base + b) * self.base + c
        key[(a == 0) | (b == 0) | (c == 0)] = 0
        return key

    def rows(self) -> list[tuple[int, list[int], list[float]]]:
        """The TF-IDF rows of the windows: number, terms, weights (unit length)."""
        out = []
        for w, keys in enumerate(self.windows):
            t, n = np.unique(np.searchsorted(self.terms, keys), return_counts=True)
            x = n * self.idf[t]
            out.append((w, t.tolist(), (x / (np.linalg.norm(x) or 1.0)).tolist()))
        return out


def _omega(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of the random test matrix, each made from its term's number, so no task needs all of it."""
    return np.stack([np.random.default_rng(7919 + int(t)).standard_normal(width) for t in terms]).astype(np.float32) if len(terms) else np.zeros((0, width), np.float32)


def randomised_svd(rows: DataFrame, n_rows: int, n_terms: int, rank: int = RANK, over: int = OVER) -> np.ndarray:
    """The right singular vectors of a sparse matrix ``rows(w, terms, weights)``, one row per term.

    The range is sampled row by row, its basis is multiplied with the columns term by term, and only
    matrices of at most (rows of one block) x (rank + oversampling) reach the driver.
    """
    width = min(rank + over, n_rows, n_terms)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ts = np.unique(np.concatenate([np.asarray(x) for x in pdf["terms"]])) if len(pdf) else np.zeros(0, int)
            om = _omega(ts, width)
            y = [np.asarray(x, np.float32) @ om[np.searchsorted(ts, np.asarray(t))] for t, x in zip(pdf["terms"], pdf["weights"])]
            yield pd.DataFrame({"w": pdf["w"], "y": [v.tobytes() for v in y]})

    got = rows.mapInPandas(sample, "w int, y binary").collect()  # rows of one block
    y = np.zeros((n_rows, width), np.float32)
    for r in got:
        y[r["w"]] = np.frombuffer(r["y"], np.float32)
    q = rows.sparkSession.sparkContext.broadcast(np.linalg.qr(y)[0].astype(np.float32))
    postings = rows.select("w", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(F.col("e.terms").alias("t"), "w", F.col("e.weights").alias("x"))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values("t")
        t, first = np.unique(pdf["t"].to_numpy(), return_index=True)
        b = np.add.reduceat(q.value[pdf["w"].to_numpy()] * pdf["x"].to_numpy(np.float32)[:, None], first, axis=0)
        yield pd.DataFrame({"t": t, "b": [v.tobytes() for v in b.astype(np.float32)]})

    b = np.zeros((n_terms, width), np.float32)
    for r in postings.repartition("t").mapInPandas(project, "t int, b binary").toLocalIterator():  # terms of one block
        b[r["t"]] = np.frombuffer(r["b"], np.float32)
    values, vectors = np.linalg.eigh(b.T @ b)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-6]
    return (b @ vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)


class Scanner:
    """Finds passages in documents, many documents at a time."""

    def __init__(self, index: Index, vectors: np.ndarray) -> None:
        scaled = vectors * index.idf[:, None]
        q = np.stack([scaled[np.searchsorted(index.terms, k)].sum(axis=0) for k in index.windows])
        self.index = index
        self.vectors = np.concatenate([scaled, np.zeros((1, scaled.shape[1]), np.float32)])
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32).T.copy()

    def candidates(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, places of windows and numbers of passages with the cosine wanted; document d has the words from
        ``bounds[d]`` to two before ``bounds[d + 1]``, and its windows start from its first word."""
        ix, search = self.index, self.index.search
        keys = ix.grams(ids)
        at = np.minimum(np.searchsorted(ix.terms, keys), len(ix.terms) - 1)
        known = (ix.terms[at] == keys) & (keys > 0)
        sq = np.where(known, ix.idf[at] ** 2, 0.0)
        total = np.concatenate([[0.0], np.cumsum(np.where(known, sq, ix.most**2), dtype=np.float64)])
        inside = np.concatenate([[0.0], np.cumsum(sq, dtype=np.float64)])
        span = search.width - 2
        size = np.maximum(np.diff(bounds) - 4, 0)  # trigrams of each document
        count = np.where(size > 0, np.maximum(1, -(-(size - span + search.step_doc) // search.step_doc)), 0)
        doc = np.repeat(np.arange(len(size)), count)
        starts = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * search.step_doc
        ends = np.minimum(starts + span, bounds[:-1][doc] + size[doc])
        share = (inside[ends] - inside[starts]) / np.maximum(total[ends] - total[starts], 1e-9)
        kept = share >= search.known
        doc, starts, ends = doc[kept], starts[kept], ends[kept]
        if not len(starts):
            return doc, starts, starts
        at = np.concatenate([np.where(known, at, len(self.vectors) - 1), np.full(span, len(self.vectors) - 1)])
        found, place, item = [], [], []
        for k in range(0, len(starts), 2048):
            s = starts[k : k + 2048]
            x = self.vectors[at[s[:, None] + np.arange(span)[None, :]]].sum(axis=1)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            near = x @ self.queries >= search.cosine
            rows = np.flatnonzero(near.any(axis=1))
            i, j = np.nonzero(near[rows])
            i = rows[i]
            found.append(doc[k : k + 2048][i])
            place.append(s[i])
            item.append(ix.of_item[j])
        return np.concatenate(found), np.concatenate(place), np.concatenate(item)

    def scan(self, vocabulary: list[str], ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """``(document, item)`` of the leaks in texts given as numbers of words in a vocabulary (0: no word)."""
        ix, get = self.index, self.index.ids.get
        own = np.array([0, *[get(w, 0) for w in vocabulary]], np.int64)[ids]
        doc, _, item = self.candidates(own, bounds)
        if not len(doc):
            return []
        keys = ix.grams(own)
        term = np.minimum(np.searchsorted(ix.terms, keys), len(ix.terms) - 1)
        term = np.where((ix.terms[term] == keys) & (keys > 0), term, len(ix.terms))
        out = []
        pairs = np.unique(np.stack([item, doc], axis=1), axis=0)
        for k in np.unique(pairs[:, 0]).tolist():
            passage = ix.passages[k]
            grams = ix.grams(np.asarray(passage, np.int64))
            mine = np.append(np.isin(ix.terms, grams), False)
            sparse = len(passage) // MOST_WINDOWS > ix.search.step_passage  # then not all of its trigrams are terms
            for d in pairs[pairs[:, 0] == k, 1].tolist():
                lo, hi = int(bounds[d]), int(bounds[d + 1]) - 2
                if any(leaks(passage, own[lo + a : min(lo + b, hi)].tolist()) for a, b in regions(passage, np.isin(keys[lo : hi - 2], grams) if sparse else mine[term[lo : hi - 2]])):
                    out.append((d, ix.items[k]))
        return sorted(out, key=lambda x: x[0])


def regions(passage: list[int], hits: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text where enough of the passage's trigrams (``hits``, by place) stand close enough together for a leak."""
    need = needed(len(passage))
    changed = int(CHANGED * need + 1e-9)
    least = need - 2 - 3 * max(changed, int(need >= 5 and need < 10)) - (need >= 10)
    width = need + changed + 2
    if hits.sum() < least:
        return []
    sums = np.concatenate([[0], np.cumsum(hits)])
    ends = np.minimum(np.arange(len(hits)) + width, len(hits))
    at = np.flatnonzero(sums[ends] - sums[:-1] >= max(least, 1))
    if not len(at):
        return []
    parts = np.split(at, np.flatnonzero(np.diff(at) > len(passage)) + 1)
    return [(max(0, int(p[0]) - len(passage) - 5), int(p[-1]) + width + len(passage) + 5) for p in parts]


def tokenised(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, all texts as numbers from 1 with two zeros after each, and where each begins."""
    numbers: dict[str, int] = {}
    lists = [[numbers.setdefault(w, len(numbers) + 1) for w in words(t)] if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) + 2 for x in lists])]).astype(np.int64)
    ids = np.zeros(bounds[-1] + 2, np.int64)
    for x, s in zip(lists, bounds):
        ids[s : s + len(x)] = x
    return list(numbers), ids, bounds


def _block(spark: SparkSession, items: list[tuple[int, list[str]]]) -> Broadcast | None:
    """The indexes of one block of passages, one for each way to search that it needs."""
    parts = []
    for search, below in zip(SEARCHES, (10**9, *[s.need for s in SEARCHES])):
        index = Index([x for x in items if search.need <= needed(len(x[1])) < below], search)
        if index.windows:
            rows = spark.createDataFrame(index.rows(), "w int, terms array<int>, weights array<float>").repartition(spark.sparkContext.defaultParallelism)
            parts.append((index, randomised_svd(rows, len(index.windows), len(index.terms))))
    return spark.sparkContext.broadcast(parts) if parts else None


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The passages of three words or more as lists of words, in blocks of ``most`` words (or one longer passage)."""
    block, size = [], 0
    for r in items.select("item_id", "passage").where("passage is not null").orderBy("item_id", "passage").toLocalIterator():
        w = words(r[1])
        if len(w) < 3:
            continue
        if block and size + len(w) > most:
            yield block
            block, size = [], 0
        block.append((r[0], w))
        size += len(w)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents(doc_id, text)`` and ``items(item_id, passage)`` to ``(doc_id, item_id)``.

    The blocks' indexes are broadcast one by one, and a task has one of them in memory at a time.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)])
    shared = [b for b in (_block(spark, x) for x in blocks(items, block_words)) if b is not None]
    if not shared:
        return spark.createDataFrame([], schema)

    def scanners(b: Broadcast) -> list[Scanner]:
        made = [Scanner(*x) for x in b.value]
        if len(shared) > 1:
            b.__dict__.pop("_value", None)  # read again from this machine's copy when its turn comes
        return made

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = scanners(shared[0]) if len(shared) == 1 else None
        most = 2_000_000 if kept else 40_000_000  # characters looked at together; reading a block again must be worth it
        for pdf in batches:
            docs, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            group = np.cumsum([len(t) for t in texts]) // most
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, [g, g + 1])
                text = tokenised(texts[lo:hi])
                for b in shared:
                    for scanner in kept or scanners(b):
                        yield pd.DataFrame([(docs[lo + d], item) for d, item in scanner.scan(*text)], columns=["doc_id", "item_id"])

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(scan, schema)
