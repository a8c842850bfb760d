import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def plain_tree(digests):
    """(root, siblings (left, right) of each leaf)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            first = i - i % 3
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        at = [i // 3 for i in at]
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    """Rows of (doc_id, source, leaf, subroot, root, proof)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0], plain_leaf(*r[:5])))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in names:
        leaves = sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built.append((s, leaves, *plain_tree([x[1] for x in leaves])))
    root, above = plain_tree([b[2] for b in built])
    return [(i, s, leaf, sub, root, tuple(p + up)) for (s, leaves, sub, paths), up in zip(built, above, strict=True) for (i, leaf), p in zip(leaves, paths, strict=True)]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    sizes = {"a": 100, "b": 1, "": 28, None: 3, "é": 10, "Z": 81, "z2": 82, "c": 9, "d": 4}
    out = [(draw.randrange(10_000), s, draw.choice(["en", None]), draw.choice([7, None]), draw.choice(["x\ny", "", None, "é" * 5]) if i % 3 else f"text {i}\n", "p", "r") for s, n in sizes.items() for i in range(n)]
    return out + [(None, "a", None, None, None, None, None), (5, "a", "en", 1, "same\n", "p", "r"), (5, "a", "en", 1, "same\n", "p", "r"), (5, "a", "en", 1, "other", "p", "r")]


@pytest.mark.parametrize("height", [0, 1, 2, 7])
def test_same_as_plain_trees(spark, rows, height):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(merkle.leaves(docs), height).collect()
    found = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in got]
    assert sorted(found, key=str) == sorted(plain(rows), key=str)


def test_what_changed_is_told(spark, rows):
    got = merkle.audited(spark.createDataFrame(rows, SCHEMA)).collect()
    import zlib

    changed = sorted(str(r[0]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or ""))
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got if not r["verified"]) == changed and changed
    proofs = sorted((x[2], h("".join(a + b for a, b in x[5]))) for x in plain(rows))
    assert sorted((r["leaf"], r["proof_sha256"]) for r in got) == proofs


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.audited(empty).collect() == []
    one = merkle.audited(spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == h("-----") and one["proof_sha256"] == h() and one["verified"]


def test_a_meeting_has_no_more_rows_than_the_fanout(spark):
    blocks = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("block"), F.lit(1000).cast("long").alias("n_blocks"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    root, paths = plain_tree([h(str(i)) for i in range(1000)])
    got = {r["block"]: r for r in merkle.exchanged(blocks).collect()}
    assert len(got) == 1000 and all(r["subroot"] == root and [tuple(s) for s in r["path"]] == paths[b] for b, r in got.items())
