import hashlib
import random

import numpy as np
import pytest

from seqspark.llm import periodic

SCHEMA = "doc_id long, text string, start string, length string"


def plain_runs(w, least=periodic.LEAST, power=periodic.POWER):
    """Every period by itself."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, power * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


CASES = {
    "random": lambda d: [d.randrange(d.choice([1, 2, 3])) for _ in range(d.randrange(300))],
    "powers": lambda d: [x for _ in range(6) for x in [d.randrange(3) for _ in range(d.randrange(1, 14))] * d.randrange(1, 9)],
    "nested": lambda d: ([d.randrange(2)] * d.randrange(1, 5) + [2]) * d.randrange(1, 8) * d.randrange(1, 4) + [d.randrange(3) for _ in range(9)] + [0, 1] * 20,
    "fibonacci": lambda d: fibonacci(d.randrange(400)) * d.randrange(1, 4),
    "thue_morse": lambda d: [bin(i).count("1") % 2 for i in range(d.randrange(300))] * d.randrange(1, 5),
    "long_periods": lambda d: [d.randrange(40) for _ in range(d.randrange(20, 200))] * d.randrange(2, 6),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_all_runs(case):
    draw = random.Random(case)
    n = 0
    for _ in range(60):
        w = CASES[case](draw)
        for _ in range(draw.randrange(3)):
            if w:
                w[draw.randrange(len(w))] = draw.randrange(3)
        want = plain_runs(w)
        n += len(want)
        assert [tuple(x) for x in zip(*(c.tolist() for c in periodic.runs(np.array(w, np.uint64))), strict=True)] == want
    assert n or case in ("random", "thue_morse")


def test_wavelet_tree():
    draw = np.random.default_rng(5)
    values = draw.permutation(500)[:130]
    tree = periodic.WaveletTree(values)
    low = draw.integers(0, 130, 200)
    high = np.minimum(130, low + draw.integers(1, 60, 200))
    at = draw.integers(0, 2000, 200)
    for a, b, x, n in zip(low, high, at, tree.below(low, high, at), strict=True):
        assert n == (values[a:b] < x).sum()
    assert all(np.sort(values[a:b])[(b - a) // 2] == v for a, b, v in zip(low, high, tree.nth(low, high, (high - low) // 2), strict=True))


def test_collapsed(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    phrase = "eins zwei drei vier fünf sechs"
    rows = [(1, f"vor {' '.join([phrase] * 5)}\neins nach", "x", "y"), (2, None, "x", None), (3, "", None, "y"), (None, "ja " * 30, "x", "y"), (4, f"{long} {long} {long}", "x", "y"), (4, "no no no", "x", "y"), (4, "no no no", "x", "y")]
    got = {}
    for r in periodic.collapsed(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert tuple(got[1][0])[1:7] == (1, 1, 31, 6, 5166, digest("1,31,6\n")) and got[1][0]["collapsed_sha256"] == digest(f"vor {phrase} nach")
    assert tuple(got[None][0])[1:6] == (1, 0, 30, 1, 30_000) and got[None][0]["collapsed_sha256"] == digest("ja")
    assert [tuple(got[k][0])[1:] for k in (2, 3)] == [(0, None, None, None, None, digest(""), digest(""))] * 2
    four = sorted(got[4], key=lambda r: r["n_runs"])
    assert four[0] == four[1] and four[0]["collapsed_sha256"] == digest("no no no")
    assert tuple(four[2])[1:6] == (1, 0, 120_000, 40_000, 3000) and four[2]["collapsed_sha256"] == digest(long)
    assert periodic.collapsed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_do_not_run_into_each_other(spark):
    rows = [(i, "a b " * 11, "", "") for i in range(9)]
    assert all(r["n_runs"] == 0 for r in periodic.collapsed(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())
