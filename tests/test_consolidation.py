import random
import time

import numpy as np
import pytest

from lodeweave.functions import similarity as S
from lodeweave.operators import consolidation


def sequential(heads, tails, threshold):
    of = []
    for i, (h, t) in enumerate(zip(heads, tails)):
        best, at = 0.0, i
        for j in (j for j in range(i) if of[j] == j):
            s = 0.52 * S.consolidated(h, heads[j]) + 0.42 * S.consolidated(t, tails[j]) + 0.06
            if s > best and s >= threshold:
                best, at = s, j
        of.append(at)
    return of


def labels(n, seed):
    rnd = random.Random(seed)
    names = ["spindle motor", "servo drive", "feed pump", "oil cooler", "emergency stop", "light curtain", "gearbox", "a b c verylongwordhere", "c b a"]
    return [rnd.choice(names) + rnd.choice(["", f" {rnd.randint(1, 40)}", f" k{rnd.randint(1, 5)} {rnd.randint(1, 9)}"]) for _ in range(n)]


ODD = ["", "a", "aa", "ab ab ab", "ba ba ba", "x" * 64, "x" * 65, "pump " * 13 + "a", "valve " * 40 + "open", "valve " * 40 + "shut", "open " + "valve " * 40]


@pytest.mark.parametrize("sizes", [(1000, 512, 8192, 1_000_000), (7, 3, 5, 11)])
@pytest.mark.parametrize("threshold", [0.86, 0.5])
def test_founders_equal_sequential(monkeypatch, sizes, threshold):
    for name, n in zip(("BLOCK", "ROWS", "COLUMNS", "PAIRS"), sizes):
        monkeypatch.setattr(consolidation, name, n)
    heads, tails = labels(250, 1) + [x for x in ODD for _ in ODD], labels(250, 2) + ODD * len(ODD)
    keys = list(dict.fromkeys(zip(heads, tails)))
    random.Random(3).shuffle(keys)
    heads, tails = [k[0] for k in keys], [k[1] for k in keys]
    assert consolidation.founders(heads, tails, threshold).tolist() == sequential(heads, tails, threshold)
    assert consolidation.founders([], []).tolist() == []


def test_similarity_of_many_pairs():
    rnd = random.Random(5)
    texts = list(dict.fromkeys(labels(60, 4) + ODD + ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 64))).strip() for _ in range(80)]))
    t = S.Texts(texts)
    a, b = (x.ravel() for x in np.indices((len(texts), len(texts))))
    want = np.array([S.consolidated(texts[i], texts[j]) for i, j in zip(a, b)])
    assert t.near(a, b).tolist() == want.tolist()
    assert (t.bound(a, b) >= want - consolidation.SLACK).all() and (t.bounds(a[:: len(texts)], b[: len(texts)]).ravel() >= want - consolidation.SLACK).all()


def test_many_keys_of_one_predicate(spark):
    """Ten thousand keys in seconds; one pair after the other they take minutes."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(5, 9)))
    words = [word() for _ in range(400)]
    rows = [(0, f"{rnd.choice(words)} {rnd.choice(words)} {i % 50}", "causes", f"{rnd.choice(words)} {rnd.choice(words)}", i) for i in range(10_000)]
    r = spark.createDataFrame(rows, "stop int, head string, predicate string, tail string, ord int")
    began = time.time()
    got = {x["ord"]: x["cluster"] for x in consolidation.fuzzy_clusters(r).collect()}
    assert time.time() - began < 60
    assert len(got) == len(rows) and [got[i] for i in range(200)] == sequential([x[1] for x in rows[:200]], [x[3] for x in rows[:200]], 0.86)
