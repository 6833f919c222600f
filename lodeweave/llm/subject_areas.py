"""Subject areas of documents from labelling functions whose accuracy is learned.

Each sentence gets votes of five labelling functions that look at different things: its words, by a
lexicon learned from hand-labelled documents; its words, by the areas' descriptions; the domains of the
addresses in it; its section, by the heading's words or else by the words of the two sentences on either side; and
the document's source. A latent model then learns, by expectation maximisation over the counts
of all vote patterns of all sentences, how often each function abstains and how often it is right,
and gives each pattern posterior probabilities of the areas (or of none). A document has the areas
that make up at least a fifth of its sentences, by the sum of the posterior probabilities to the nearest whole sentence.

The first lexicon is fitted on at most ``MOST_LABELLED`` labelled documents, chosen by the hash of
their id (a bounded sample; every other count covers all documents). Page furniture has no full
stop of its own and counts as no sentence. Null, empty and contentless texts have no area.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut

#: Labelled documents that the lexicon is fitted on, at most.
MOST_LABELLED = 1500
#: Natural-log margin a lexicon's vote needs; share of sentences that makes an area; votes' functions.
MARGIN, SHARE, FUNCTIONS = 2.5, 0.2, 5

_BREAK = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?:[>|*#]+\s*)?(?=[a-zà-ÿ])")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
#: A line without marks that end or part a sentence, after an empty line (two are put before a text).
_HEADING = re.compile(r"\n[ \t]?\n([^\W_][^\n.!?:;,]{0,98})(?=\n)")
#: Posteriors below this are left out of the sums; they cannot move a document's share by more.
LEAST_POSTERIOR = 1e-3
_END = re.compile(r"[.!?][\"'»”)\]]*\s+(?=[\"«“(]?[A-ZÀ-Ý])")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DOMAIN = re.compile(r"(?:https?://|www\.|@)(?:[\w-]+\.)*([\w-]+\.[a-z]{2,})", re.I)
_LOSS = re.compile("[­​‌‍⁠﻿]")


def repaired(text: str) -> str:
    """Text without markup, with broken words joined and UTF-8 that was read as Latin-1 put right."""
    t = text
    if not t.isascii():
        t = _LOSS.sub("", t)
        if "Ã" in t or "Â" in t or "â€" in t:
            for code in ("cp1252", "latin-1"):
                try:
                    t = re.sub(r"[\u0080-ÿŒ-™]{2,}", lambda m: m[0].encode(code, "strict").decode("utf-8", "strict"), t)
                    break
                except (UnicodeEncodeError, UnicodeDecodeError):
                    t = re.sub(r"[ÃÂ][\u0080-ÿ]", lambda m: m[0].encode("latin-1").decode("utf-8", "replace"), t)
    if "<" in t:
        t = _TAG.sub("\n", t)
    if "-\n" in t or "‐\n" in t:
        t = _BREAK.sub("", t)
    return t


def sentences(text: str, headings: list[str] | None = None) -> list[str]:
    """Sentences that end in a full stop, or have at least six words; headings and page numbers join the next one.

    ``headings`` gets the last heading before each sentence ('' for none), which is then left out of the sentence.
    """
    out, seen = [], [""]
    at = 0
    plain = repaired(text)
    if headings is not None and "\n" in plain:
        plain = _HEADING.sub(lambda m: seen.append(m[1]) or "\n" + m[1] + "\x03", "\n\n" + plain.replace("\x03", " "))
    parts = _END.split(re.sub(r"\s+", " ", plain))
    for i, s in enumerate(parts):
        if "\x03" in s:
            at += s.count("\x03")
        n = len(_WORD.findall(s))
        s = s.rpartition("\x03")[2].strip()  # a heading's words are the section's, not the sentence's
        if n >= 6 or n >= 3 and (i + 1 < len(parts) or s[-1:] in ".!?"):
            out.append(s)
            if headings is not None:
                headings.append(seen[at])
    return out


def bag(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def fit_lexicon(docs: list[tuple[str, list[str]]], areas: list[str], described: dict[str, list[str]], rounds: int = 12) -> tuple[dict[str, int], np.ndarray]:
    """Word weights per area from documents with (sometimes wrong) labels.

    A mixture model in which each sentence has one area, started from the labels of its document and
    settled by expectation maximisation; a sentence's area may leave its document's labels.
    """
    ids: dict[str, int] = {}
    rows, cols, doc_of = [], [], []
    prior = []
    index = {a: k for k, a in enumerate(areas)}
    n_s = 0
    for d, (text, labels) in enumerate(docs):
        p = np.full(len(areas), 0.02)
        for a in labels:
            if a in index:
                p[index[a]] += 1.0
        prior.append(p / p.sum())
        for s in sentences(text):
            for w in set(bag(s)):
                rows.append(n_s)
                cols.append(ids.setdefault(w, len(ids)))
            doc_of.append(d)
            n_s += 1
    for ws in described.values():
        for w in ws:
            ids.setdefault(w, len(ids))
    seed = np.full((len(ids), len(areas)), 0.05)
    for a, ws in described.items():
        for w in ws:
            seed[ids[w], index[a]] += 0.5
    if not n_s:
        p = seed / seed.sum(axis=0)
        return ids, np.log(p) - np.log(p).mean(axis=1, keepdims=True)
    rows_a, cols_a, doc_a = np.asarray(rows), np.asarray(cols), np.asarray(doc_of)
    prior_a = np.stack(prior)
    post, theta = prior_a[doc_a], prior_a
    first = np.searchsorted(rows_a, np.arange(n_s))
    weight = np.zeros((len(ids), len(areas)))
    for _ in range(rounds):
        counts = seed.copy()
        np.add.at(counts, cols_a, post[rows_a])
        p = counts / counts.sum(axis=0)
        weight = np.log(p) - np.log(p).mean(axis=1, keepdims=True)
        score = np.zeros((n_s, len(areas)))
        has = np.bincount(rows_a, minlength=n_s) > 0
        score[has] = np.add.reduceat(weight[cols_a], first[has], axis=0)
        score += np.log(theta[doc_a] + 0.01)
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
        sums = prior_a.copy()
        np.add.at(sums, doc_a, post)
        theta = sums / sums.sum(axis=1, keepdims=True)
    return ids, weight


def described_words(rows: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    """The words of each area's name and description, with simple singulars."""
    out = {}
    for code, name, text in rows:
        ws = {w for w in bag(f"{name or ''} {text or ''}") if len(w) > 3}
        out[code] = sorted(ws | {w[:-1] for w in ws if w.endswith("s")} | {w[:-2] for w in ws if w.endswith("es")})
    return out


class Voter:
    """The labelling functions."""

    def __init__(self, ids: dict[str, int], weight: np.ndarray, described: dict[str, list[str]], areas: list[str], by_source: dict[str, int], by_domain: dict[str, int]) -> None:
        self.ids, self.k, self.by_source, self.by_domain = ids, len(areas), by_source, by_domain
        self.weight = np.concatenate([weight, np.zeros((1, weight.shape[1]))]).astype(np.float32)
        self.heading: dict[str, int] = {}
        self.described = {w: k + 1 for k, a in enumerate(areas) for w in described.get(a, [])}
        clash = Counter(w for a in areas for w in described.get(a, []))
        self.described = {w: k for w, k in self.described.items() if clash[w] == 1}

    def votes(self, texts: list[str | None], sources: list[str | None]) -> Iterator[list[tuple[int, ...]]]:
        """One list per document with the votes of each sentence; 0 is an abstention."""
        none = len(self.weight) - 1
        flat: list[int] = []
        starts, per_doc, second, third, fourth = [], [], [], [], []
        for t in texts:
            heads: list[str] = []
            ss = sentences(t, heads) if t else []
            per_doc.append(len(ss))
            fourth += [self.section(h) if h else 0 for h in heads]
            for s in ss:
                ws = set(bag(s))
                starts.append(len(flat))
                flat += [self.ids.get(w, none) for w in ws] or [none]
                hits = Counter(self.described[w] for w in ws if w in self.described).most_common(2)
                second.append(hits[0][0] if hits and (len(hits) == 1 or hits[0][1] > hits[1][1]) else 0)
                third.append(self.address(s) if "@" in s or "://" in s or "www." in s else 0)
        if starts:
            score = np.add.reduceat(self.weight[np.asarray(flat)], starts, axis=0)
            order = np.sort(score, axis=1)
            lead = order[:, -1] - order[:, -2] if self.k > 1 else order[:, -1]
            first = np.where(lead >= MARGIN, score.argmax(axis=1) + 1, 0).tolist()
        at = 0
        for n, source in zip(per_doc, sources):
            own = first[at : at + n] if n else []
            out = []
            for i in range(n):
                near = [x for x in own[max(0, i - 2) : i] + own[i + 1 : i + 3] if x]
                top = Counter(near).most_common(1)
                section = fourth[at + i] or (top[0][0] if top and top[0][1] * 2 > len(near) else 0)
                out.append((own[i], second[at + i], third[at + i], section, self.by_source.get(source or "", 0)))
            at += n
            yield out

    def address(self, sentence: str) -> int:
        """The area of the domains in a sentence, if they agree."""
        found = {self.by_domain.get(d.lower(), 0) for d in _DOMAIN.findall(sentence)} - {0}
        return found.pop() if len(found) == 1 else 0

    def section(self, heading: str) -> int:
        """The area of a heading's words by the learned lexicon."""
        if heading not in self.heading:
            if len(self.heading) > 50_000:
                self.heading.clear()
            ws = [self.ids[w] for w in set(bag(heading)) if w in self.ids]
            score = np.sort(self.weight[ws].sum(axis=0)) if ws else np.zeros(2)
            self.heading[heading] = int(self.weight[ws].sum(axis=0).argmax()) + 1 if ws and self.k > 1 and score[-1] - score[-2] >= MARGIN else 0
        return self.heading[heading]


def mostly(pairs: list[tuple[str, int]], least: int = 5) -> dict[str, int]:
    """What each key stands for, if it is seen ``least`` times and one area makes up half of that."""
    seen: dict[str, Counter] = {}
    for key, area in pairs:
        seen.setdefault(key, Counter())[area] += 1
    return {k: c.most_common(1)[0][0] for k, c in seen.items() if sum(c.values()) >= least and c.most_common(1)[0][1] >= 0.5 * sum(c.values())}


def learn_accuracies(patterns: np.ndarray, counts: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    """Posterior of (none, area 1..k) for each vote pattern, by expectation maximisation.

    Each function abstains with its own probability on sentences with and without an area, and is
    right with its own accuracy where it votes.
    """
    m = patterns.shape[1]
    right = np.array([0.95, 0.85, 0.85, 0.75, 0.5])[:m]
    silent = np.array([0.05, 0.6, 0.98, 0.3, 0.6])[:m]
    silent_none = np.array([0.95, 0.95, 0.99, 0.5, 0.6])[:m]
    prior = np.concatenate([[0.05], np.full(k, 0.95 / k)])
    post = np.zeros((len(patterns), k + 1))
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        like = np.tile(prior, (len(patterns), 1))
        for j in range(m):
            v = patterns[:, j][:, None]
            y = np.arange(k + 1)[None, :]
            on = np.where(v == 0, silent[j], (1 - silent[j]) * np.where(v == y, right[j], (1 - right[j]) / max(k - 1, 1)))
            off = np.where(v[:, 0] == 0, silent_none[j], (1 - silent_none[j]) / k)
            on[:, 0] = off
            like *= on
        post = like / np.maximum(like.sum(axis=1, keepdims=True), 1e-300)
        w = post * counts[:, None]
        prior = (w.sum(axis=0) + 0.5) / (total + 0.5 * (k + 1))
        area = w[:, 1:].sum(axis=1)
        for j in range(m):
            v = patterns[:, j]
            voted = v > 0
            hit = np.where(voted, w[np.arange(len(v)), v], 0.0).sum()
            said = area[voted].sum()
            right[j] = np.clip((hit + 2 * right[j]) / (said + 2), 0.3, 0.995)
            silent[j] = np.clip((area[~voted].sum() + 1) / (area.sum() + 2), 0.005, 0.995)
            silent_none[j] = np.clip((w[~voted, 0].sum() + 2 * silent_none[j]) / (w[:, 0].sum() + 2), 0.3, 0.995)
        silent_none[0] = max(silent_none[0], 0.9)
    return post


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame, most: int = MOST_LABELLED, share: float = SHARE) -> DataFrame:
    """``(doc_id, area_code, n_area, n_sentences)`` for the areas that make up the share wanted."""
    spark = documents.sparkSession
    rows = sorted((r[0], r[1], r[2]) for r in areas.select("area_code", "area_name", "description").where("area_code is not null").distinct().collect())  # the list of areas, which the lexicon has a column for each of
    codes = [r[0] for r in rows]
    k = len(codes)
    known = labels.select("doc_id", F.lower(F.trim("area_code")).alias("area_code")).where(F.col("area_code").isin(codes)).distinct()
    sample = known.groupBy("doc_id").agg(F.collect_set("area_code").alias("labels")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a label per area at most
    train = documents.select("doc_id", "text", "source").where("text is not null").join(sample, "doc_id").orderBy("doc_id").collect()  # at most ``most`` documents
    described = described_words(rows)
    ids, weight = fit_lexicon([(r["text"], list(r["labels"])) for r in train], codes, described)
    of = lambda r: [codes.index(a) + 1 for a in r["labels"]]
    by_source = mostly([(r["source"] or "", a) for r in train for a in of(r)])
    by_domain = mostly([(d.lower(), a) for r in train for d in set(_DOMAIN.findall(r["text"])) for a in of(r)])
    shared = spark.sparkContext.broadcast((ids, weight, described, codes, by_source, by_domain))
    doc_type = documents.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voter = Voter(*shared.value)
        for pdf in batches:
            for s in range(0, len(pdf), 500):
                part = pdf.iloc[s : s + 500]
                out = []
                for doc, votes in zip(part["doc_id"], voter.votes(part["text"].tolist(), part["source"].tolist())):
                    for p, n in Counter(votes).items():
                        code = 0
                        for v in p:
                            code = code * (k + 1) + v
                        out.append((doc, code, n))
                yield pd.DataFrame(out, columns=["doc_id", "pattern", "n"])

    votes = cut(documents.select("doc_id", "text", "source").where("text is not null").mapInPandas(vote, f"doc_id {doc_type}, pattern bigint, n bigint"))
    found = votes.groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most (areas + 1) ^ functions, whatever the corpus
    if not found:
        return spark.createDataFrame([], f"doc_id {doc_type}, area_code string, n_area double, n_sentences bigint")
    codes_seen = np.array([r["pattern"] for r in found])
    digits = np.stack([(codes_seen // (k + 1) ** j) % (k + 1) for j in range(FUNCTIONS - 1, -1, -1)], axis=1)
    post = learn_accuracies(digits, np.array([r["n"] for r in found], float), k)
    meant = [(int(p), codes[a - 1], float(post[i, a])) for i, p in enumerate(codes_seen) for a in range(1, k + 1) if post[i, a] > LEAST_POSTERIOR]
    verdict = spark.createDataFrame(meant, "pattern bigint, area_code string, p double")
    per_area = votes.join(verdict, "pattern").groupBy("doc_id", "area_code").agg(F.sum(F.col("n") * F.col("p")).alias("n_area"))
    whole = votes.groupBy("doc_id").agg(F.sum("n").alias("n_sentences"))
    return per_area.join(whole, "doc_id").where((F.round("n_area") >= 1) & (F.round("n_area") >= share * F.col("n_sentences") - 1e-9)).select("doc_id", "area_code", "n_area", "n_sentences")
