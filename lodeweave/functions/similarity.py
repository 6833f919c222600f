"""String similarities: set measures as Column expressions, character measures as Arrow functions.

Character measures are built on the longest common subsequence: ``ratio`` is 100 * 2 * LCS / (length + length).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.functions import normalizers as N


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words, 0 to 1, of two normalized texts; 0 if one is empty."""
    x, y = N.tokens(a), N.tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.size(F.array_union(x, y))).otherwise(0.0)


def containment(a: Column, b: Column, stop_words: list[str] | None = None) -> Column:
    """Shared words over the shorter text's words."""
    clean = lambda t: F.array_except(N.tokens(t), F.array(*[F.lit(w) for w in stop_words])) if stop_words else N.tokens(t)
    x, y = clean(a), clean(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def trigrams(c: Column, n: int = 3) -> Column:
    """The distinct character n-grams; a shorter text is its own one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: c.substr(i, F.lit(n)))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.size(F.array_union(x, y))).otherwise(0.0)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit vector."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of comparing shared words with each side's words; 100 if one side has no words of its own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not p or not q):
        return 100.0
    left, right = f"{shared} {p}".strip(), f"{shared} {q}".strip()
    scores = [ratio(left, right)]
    if shared:
        scores += [ratio(shared, left), ratio(shared, right)]
    return max(scores)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one; windows may hang over its ends."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n, best = len(a), 0.0
    for s in range(1 - n, len(b)):
        w = b[max(0, s) : s + n]
        if w and (w[0] in a or w[-1] in a):
            best = max(best, ratio(a, w))
            if best == 100.0:
                break
    return best


def strict(a: str, b: str) -> float:
    return 100.0 if a and a == b else min(ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b)) if a and b else 0.0


def matcher(a: str, b: str) -> float:
    """difflib's ratio; its result depends on the order of the arguments."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _arrow(f):
    @F.pandas_udf(T.DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return over


ratio_udf, token_sort_udf, token_set_udf, partial_udf, strict_udf, matcher_udf = (_arrow(f) for f in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, strict, matcher))


def consolidated(a: str, b: str) -> float:
    """The higher of word overlap and difflib's ratio, 0 to 1; two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio())


consolidated_udf = _arrow(consolidated)

#: Longest text whose positions fit in a machine word; longer ones are compared one by one.
WORD = 64


class Texts:
    """Normalized texts (a-z, digits, spaces) as arrays, for ``consolidated`` over many pairs of them at once.

    Pairs are arrays of places in the list.
    """

    def __init__(self, texts: list[str]):
        self.texts, self.n = texts, len(texts)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.words = [frozenset(t.split()) for t in texts]
        self.n_words = np.array([len(w) for w in self.words], dtype=np.int64)
        rows = np.arange(self.n)
        letters, words = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.array([x for w in self.words for x in w], dtype=object)
        self.letters = _ones(np.repeat(rows, self.size), pd.factorize(letters)[0], self.n)
        self.letters = np.column_stack((self.letters, (self.size == 0).astype(np.uint8)))  # the empty text equals itself
        self.buckets = _ones(np.repeat(rows, self.n_words), pd.factorize(words)[0] % WORD, self.n)
        self.letter_bits, self.bucket_bits = _machine_words(self.letters), _machine_words(self.buckets)
        self.halves, self.counts = np.maximum(self.size, 1).astype(np.float32) / 2, np.maximum(self.n_words, 1).astype(np.float32)
        short = min(WORD, int(self.size.max(initial=1)))
        self.codes = np.array([t[:short].encode() for t in texts], dtype=f"S{short}").view(np.uint8).reshape(self.n, short)

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A table of what the similarity of each of ``a`` with each of ``b`` is at most, by their letters and (hashed) words."""
        one = lambda m, x: m[x].astype(np.float32)
        letters, words = one(self.letters, a) @ one(self.letters, b).T, one(self.buckets, a) @ one(self.buckets, b).T
        letters /= self.halves[a, None] + self.halves[b]
        words /= self.counts[a, None] + self.counts[b] - words
        return np.maximum(letters, words, out=letters)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for pairs."""
        letters, words = (sum(np.bitwise_count(w[a] & w[b]).astype(np.float32) for w in m) for m in (self.letter_bits, self.bucket_bits))
        return np.maximum(letters / (self.halves[a] + self.halves[b]), words / (self.counts[a] + self.counts[b] - words))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``consolidated`` of pairs."""
        out = np.where(a == b, 1.0, 0.0)
        todo = np.flatnonzero((a != b) & (self.size[a] > 0) & (self.size[b] > 0))
        long = np.maximum(self.size[a[todo]], self.size[b[todo]])
        for i in todo[long > WORD]:
            out[i] = consolidated(self.texts[a[i]], self.texts[b[i]])
        todo = todo[np.argsort(long, kind="stable")][: int((long <= WORD).sum())]
        for at in range(0, len(todo), 8192):
            some = todo[at : at + 8192]
            x, y = a[some], b[some]
            both = np.array([len(self.words[i] & self.words[j]) for i, j in zip(x.tolist(), y.tolist())], dtype=np.int64)
            matched = _matched(self.codes[x], self.codes[y], self.size[x], self.size[y])
            out[some] = np.maximum(both / (self.n_words[x] + self.n_words[y] - both), 2.0 * matched / (self.size[x] + self.size[y]))
        return out


def _ones(rows: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows with a 1 for the first, second, .. of each of their parts, so a product of two rows counts what both have."""
    kinds = int(parts.max(initial=-1)) + 1
    many = np.bincount(rows * kinds + parts, minlength=n * kinds).reshape(n, kinds)
    most = many.max(axis=0, initial=0)
    return np.concatenate([many[:, most > k] > k for k in range(max(1, int(most.max(initial=0))))], axis=1).astype(np.uint8, order="C")


def _machine_words(m: np.ndarray) -> list[np.ndarray]:
    """The columns of a table of zeros and ones, 64 to a word."""
    packed = np.ascontiguousarray(np.packbits(np.pad(m, ((0, 0), (0, -m.shape[1] % WORD or WORD * (not m.shape[1])))), axis=1))
    return list(np.ascontiguousarray(packed.view(np.uint64).T))


def _matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """How many letters difflib matches in each pair of rows: the longest common block (the first in ``a``, then in ``b``), then those on both sides of it.

    A bit of ``same[pair, diagonal]`` says that the letter of ``a`` at this place equals the one of ``b`` on this diagonal.
    """
    wa, wb = int(la.max()), int(lb.max())
    kind = np.uint32 if wa <= 32 else np.uint64
    a, b = a[:, :wa], np.where(np.arange(wb) < lb[:, None], b[:, :wb], 255)
    same = np.zeros((len(a), wa + wb - 1), dtype=kind)
    for i in range(wa):
        same[:, wa - 1 - i : wa - 1 - i + wb] |= (a[:, i : i + 1] == b).astype(kind) << kind(i)
    shift = np.arange(wa + wb - 1) - (wa - 1)
    below = np.array([(1 << i) - 1 for i in range(wa + 1)], dtype=kind)  # the bits before a place
    total, row, at = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), [np.zeros_like(la), la, np.zeros_like(lb), lb]
    first = True
    while len(row):
        a0, a1, b0, b1 = at
        runs = same[row]
        if not first:
            lo, hi = np.maximum(a0[:, None], b0[:, None] - shift), np.minimum(a1[:, None], b1[:, None] - shift)
            runs &= np.where(lo < hi, below[hi.clip(0, wa)] & ~below[lo.clip(0, wa)], kind(0))
        first = False
        open_, starts = np.arange(len(row)), runs
        size, i, j = (np.zeros(len(row), dtype=np.int64) for _ in range(3))
        k = 0
        while len(open_):
            k += 1
            on = starts.any(axis=1)
            ended = open_[~on]
            if k > 1 and len(ended):
                _place(ended, before[~on], shift, size, i, j, k - 1)
            open_, before = open_[on], starts[on]
            runs = runs[on] if not on.all() else runs
            starts = before & (runs >> kind(k)) if k < wa else np.zeros_like(before)
        hit = size > 0
        total += np.bincount(row[hit], size[hit], len(total)).astype(np.int64)
        left, right = hit & (i > a0) & (j > b0), hit & (i + size < a1) & (j + size < b1)
        at = [np.concatenate(x) for x in ((a0[left], (i + size)[right]), (i[left], a1[right]), (b0[left], (j + size)[right]), (j[left], b1[right]))]
        row = np.concatenate((row[left], row[right]))
    return total


def _place(rows: np.ndarray, starts: np.ndarray, shift: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> None:
    """Notes the first of the longest blocks, of ``k`` letters, of some rows."""
    every = np.bitwise_or.reduce(starts, axis=1)
    low = every & (~every + every.dtype.type(1))
    diagonal = ((starts & low[:, None]) != 0).argmax(axis=1)
    size[rows], i[rows] = k, np.log2(low.astype(np.float64)).astype(np.int64)
    j[rows] = i[rows] + shift[diagonal]


def blended(a: str, b: str, stop_words: frozenset[str] = frozenset()) -> float:
    """The highest of word overlap, containment, trigram overlap and difflib's ratio; containment of short texts that look different counts 0.65 at most."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()) - stop_words, set(b.split()) - stop_words
    seq = SequenceMatcher(None, a, b).ratio()
    both = len(x & y)
    words = both / len(x | y) if x | y else 0.0
    inside = both / min(len(x), len(y)) if x and y else 0.0
    if min(len(x), len(y)) <= 2 and seq < 0.60:
        inside = min(inside, 0.65)
    gx, gy = ({t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in (a, b))
    return max(words, inside, len(gx & gy) / len(gx | gy), seq)


def bleu(reference: str, hypothesis: str, tokens=None, n: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU with uniform weights, brevity penalty and epsilon for orders without a match."""
    import math
    import re
    from collections import Counter

    tokens = tokens or (lambda t: re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", t.lower()))
    ref, hyp = tokens(reference or ""), tokens(hypothesis or "")
    if not ref or not hyp:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        h, r = (Counter(zip(*[t[i:] for i in range(k)])) for t in (hyp, ref))
        hit, total = sum((h & r).values()), max(1, sum(h.values()))
        if k == 1 and not hit:
            return 0.0
        logs += math.log((hit or epsilon) / total) / n
    return math.exp(logs) * (1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp)))


bleu_udf = _arrow(bleu)
