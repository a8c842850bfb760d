"""The pipeline's stages over the small tables, each against a plain version of it."""

import itertools
import re

import pytest

import corpus_pipeline
from seqspark.llm import pii, quality
from seqspark.llm.common import documents
from tests.compare import DATA

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


@pytest.fixture(scope="module")
def states(spark):
    """What each stage gets and gives: name -> (docs before, docs after), as lists of rows."""
    docs, out = documents(spark, DATA), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).persist()
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_quality(spark, states):
    before, after = states["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality(documents(spark, DATA), labels).where("predicted = 1").collect()}
    assert sorted(after) == sorted(r for r in before if r["doc_id"] in good)
    known = {r["doc_id"] for r in labels.where("quality = 1").collect()} & {r["doc_id"] for r in before}
    assert len(known & good) >= 0.98 * len(known)


def test_near_duplicates(states):
    before, after = states["near_duplicates"]
    sets = {}
    for r in before:
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in after) == [i for i in sorted(sets) if top(i) == i]


def test_decontamination(spark, states):
    before, after = states["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = WORDS.findall((r["text"] or "").encode().lower())
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    held = lambda text: any(tuple(w[i : i + n]) in windows for w in [WORDS.findall((text or "").encode().lower())] for n in sizes for i in range(len(w) - n + 1))
    left = {r["doc_id"]: r for r in after}
    hit = {r["doc_id"] for r in before if held(r["text"])}
    assert hit and not any(held(r["text"]) for r in after)
    assert all(left[r["doc_id"]] == r for r in before if r["doc_id"] not in hit)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_pii(states):
    before, after = states["pii"]
    new = {r["doc_id"]: r["text"] for r in after}
    patterns = [re.compile(p) for p in (r"[\w.%+-]+@[\w-]+\.[\w.-]*\w", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"(?<!\d)\d{13,19}(?!\d)", r"token = \"[0-9a-f]{40}", r"\+\d \(\d{3}\) \d{3}-\d{4}")]
    found = 0
    for r in before:
        private = [m for p in patterns for m in p.findall(r["text"])]
        # a number of a card's length whose check digit fails is no card and stays
        no_cards = [m for m in private if m.isdigit() and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(m)))) % 10]
        assert all(m in new[r["doc_id"]] for m in no_cards)
        private = [m for m in private if m not in no_cards]
        found += len(private)
        assert not any(m in new[r["doc_id"]] for m in private)
        if not private:
            assert new[r["doc_id"]] == r["text"]
    assert found and pii.ENTITY


def test_mixing(states):
    before, after = states["mixing"]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before)
    targets = {r["source"]: r["target"] for r in after}
    taken = {s: sum(r["taken"] for r in after if r["source"] == s) for s in targets}
    assert all(abs(taken[s] - t) <= 64 + 0.001 * t for s, t in targets.items())
    assert abs(sum(targets.values()) - total) <= 1e-6 * total + 3 * max(r["source_size"] for r in after) * (len(targets) < len({r["source"] for r in before}))
    assert all(0 < r["taken"] <= 3 * r["size"] for r in after)
