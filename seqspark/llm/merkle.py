"""A Merkle manifest of a dataset: one tree a source, one over the sources' roots, and the proof of every document.

Leaves stand in order of doc_id and are numbered by running sums over ranges. A partition is a block of FANOUT ** HEIGHT leaves at places that
are multiples of it, and hashes its own subtree. Then the blocks of a tree exchange roots as a butterfly: in round r the FANOUT blocks
that differ only in digit r of their number meet, swap the roots of their aligned groups, and each hashes the common parent for
itself. After log(blocks) rounds every block holds the root and the siblings on its whole path; nothing is handed down. Where the last aligned
group is incomplete, blocks without leaves stand in for the missing ones and hold what their group holds, so that every block has a partner in
every round. Each meeting has at most FANOUT rows, whatever the size of a source.

A node is the lower-case hex SHA-256 of what its children's digests give one after the other as text; while a level has more than one node,
every FANOUT consecutive ones become one, the last run as many as are left, even one.

Edge cases: a null source is the first source; null ids stand first; documents of equal id stand by leaf, and equal rows have a leaf each; null
values are written as ``-`` and differ from empty texts; an empty table gives an empty manifest; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, id_text, spread
from seqspark.operators.prefix import running

FANOUT, HEIGHT = 3, 7
#: Powers of the fanout that a long holds.
_POWERS = [FANOUT**k for k in range(40) if FANOUT**k < 2**63]
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written_as(value: Column) -> Column:
    """A value in a leaf: its length in UTF-8 bytes, a colon, the value; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a document's fields, some of them perhaps changed."""
    return F.sha2(F.concat(*[written_as(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def _parent(*digests: Column) -> Column:
    return F.sha2(F.concat(*digests), 256)


def _subtree(leaves: list[str], height: int | None) -> list[list[str]]:
    """Levels of nodes above some leaves: ``height`` of them, or up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return levels


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
    """The rows of each block, of batches that stand in order of tree and block."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for key, block in groupby(rows, lambda row: row[:2]):
        yield key, list(block)


def _in_blocks(rows: DataFrame, height: int) -> DataFrame:
    """Rows of tree and place dealt out by block, in order."""
    block = F.floor(F.col("place") / FANOUT**height).cast("long")
    rows = rows.select("tree", block.alias("block"), *[c for c in rows.columns if c != "tree"])
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """tree, block, n_blocks, digest: the root of each block's own subtree."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _by_block(batches)
        while some := list(islice(blocks, 16)):
            n_blocks = [-(-rows[0][3] // FANOUT**height) for _, rows in some]
            roots = [_subtree([r[4] for r in rows], height if n > 1 else None)[-1][0] for (_, rows), n in zip(some, n_blocks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int64()), pa.array(n_blocks, pa.int64()), pa.array(roots, pa.string())], ["tree", "block", "n_blocks", "digest"])

    ordered = _in_blocks(nodes.select("tree", "place", "n", "digest"), height)
    return ordered.mapInArrow(roots, "tree string, block long, n_blocks long, digest string")


def exchanged(blocks: DataFrame) -> DataFrame:
    """tree, block, subroot, path: the butterfly over blocks (tree, block, n_blocks, digest). path has the siblings left and right of the block's
    group at each round, the lowest first."""
    powers = F.array(*[F.lit(p) for p in _POWERS])
    rows = blocks.withColumn("rounds", F.size(F.filter(powers, lambda p: p < F.col("n_blocks")))).withColumn("real", F.lit(True))
    padded = F.sequence(F.col("n_blocks"), F.element_at(powers, F.col("rounds") + 1) - 1)
    lacking = rows.where((F.col("block") == 0) & (F.element_at(powers, F.col("rounds") + 1) > F.col("n_blocks")))
    stand_ins = lacking.select("tree", F.explode(padded).alias("block"), "n_blocks", F.lit(None).cast("string").alias("digest"), "rounds", F.lit(False).alias("real"))
    rows = cut(rows.unionByName(stand_ins).withColumn("path", F.array().cast(_PATH)))
    for r in range(rows.agg(F.max("rounds")).first()[0] or 0):
        active = F.col("rounds") > r
        digit = F.when(active, F.floor(F.col("block") / _POWERS[r]) % FANOUT).otherwise(0)
        rows = rows.withColumn("digit", digit).withColumn("meeting", F.col("block") - F.col("digit") * _POWERS[r])
        own = F.struct("block", "digit", "n_blocks", "rounds", "real", "digest", "path")
        met = rows.groupBy("tree", "meeting").agg(F.collect_list(own).alias("all"))
        rows = met.select("tree", F.array_sort(F.filter(F.transform("all", lambda m: F.struct(m.digit.alias("digit"), m.digest.alias("digest"))), lambda m: m.digest.isNotNull())).alias("held"), F.explode("all").alias("own"))
        left, right = (F.array_join(F.transform(F.filter("held", keep), lambda m: m.digest), "") for keep in (lambda m: m.digit < F.col("own.digit"), lambda m: m.digit > F.col("own.digit")))
        rows = rows.select("tree", "own.*", "held", left.alias("left"), right.alias("right"))
        parent = F.when(F.size("held") > 0, F.sha2(F.array_join(F.transform("held", lambda m: m.digest), ""), 256))
        step = F.concat("path", F.array(F.struct("left", "right")))
        rows = rows.select("tree", "block", "n_blocks", "rounds", "real", F.when(active, parent).otherwise(F.col("digest")).alias("digest"), F.when(active, step).otherwise(F.col("path")).alias("path"))
    return rows.where("real").select("tree", "block", F.col("digest").alias("subroot"), "path")


def _proofs(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """nodes (tree, place, n, digest, row) with subroot, root and proof, given each block's (tree, block, subroot, root, path). Of every block its
    row of path comes first, then its nodes."""

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            head, rows = rows[0], rows[1:]
            levels = _subtree([r[4] for r in rows], height if rows[0][3] > FANOUT**height else None)
            lefts, rights, offsets = [], [], [0]
            above = [(s["left"], s["right"]) for s in head[8]]
            for i in range(len(rows)):
                for level in levels[:-1]:
                    first = i - i % FANOUT
                    lefts.append("".join(level[first:i]))
                    rights.append("".join(level[i + 1 : first + FANOUT]))
                    i //= FANOUT
                lefts += [s[0] for s in above]
                rights += [s[1] for s in above]
                offsets.append(len(lefts))
            steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(_STEP))
            proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)
            columns = [pa.array([r[5] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()), pa.array([head[6]] * len(rows), pa.string()), pa.array([head[7]] * len(rows), pa.string()), proof]
            yield pa.RecordBatch.from_arrays(columns, ["row", "digest", "subroot", "root", "proof"])

    named = "tree", "block", "place", "n", "digest", "row", "subroot", "root", "path"
    null = {"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "path": F.lit(None).cast(_PATH)}
    block = F.floor(F.col("place") / FANOUT**height).cast("long")
    lower = nodes.withColumns({"block": block, **null}).select(*named)
    heads = blocks.withColumns({"place": F.lit(-1).cast("long"), "n": F.lit(0).cast("long"), "digest": F.lit(None).cast("string"), "row": F.lit(None).cast("string")}).select(*named)
    ordered = lower.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    return ordered.mapInArrow(proved, f"row string, digest string, subroot string, root string, proof {_PATH}")


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows of tree with place, from 0, and n, the number of the tree's rows."""
    out = running(rows.withColumn("one", F.lit(1).cast("long")), ["tree"], order, {"upto": "one"}, {"n": "one"})
    return out.withColumn("place", F.col("upto") - 1).drop("upto", "one")


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, source, leaf and all other columns of ``leaves``, with subroot, root and proof: an array of the siblings' digests left and right of the
    path at each level, from the leaf up through the source's root."""
    kept = F.to_json(F.struct(*[F.col(c) for c in leaves.columns if c != "leaf"]), {"ignoreNullFields": "false"})
    # the tree's name sorts as the source does, null first; equal rows are told apart by a seeded draw, which only deals them out
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = leaves.select(tree.alias("tree"), F.col("doc_id").alias("_id"), F.col("leaf").alias("digest"), kept.alias("row"), F.rand(7).alias("_draw"))
    # written before it is dealt out by ranges, for which rows are read twice: the texts are hashed once
    nodes = cut(_numbered(cut(rows), [F.col("_id"), F.col("digest"), F.col("row"), F.col("_draw")]).select("tree", "place", "n", "digest", "row"))
    lower = cut(exchanged(_block_roots(nodes, height)))
    roots = lower.where("block = 0").select(F.lit("").alias("tree"), F.col("subroot").alias("digest"), F.col("tree").alias("row"))
    sources = cut(_numbered(roots, [F.col("row")]))
    upper = exchanged(_block_roots(sources, height)).withColumn("root", F.col("subroot"))
    proofs = cut(_proofs(sources, upper, height).select(F.col("row").alias("tree"), "root", F.col("proof").alias("_above")))
    blocks = lower.join(proofs, "tree").withColumn("path", F.concat("path", "_above"))
    proved = _proofs(nodes, blocks.select("tree", "block", "subroot", "root", "path"), height)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema if f.name != "leaf")
    return proved.withColumn("r", F.from_json("row", schema)).select("r.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, source, leaf of each document, and the columns ``more``."""
    return spread(docs.select(*FIELDS)).select("doc_id", "source", leaf().alias("leaf"), *[c.alias(n) for n, c in more.items()])


def folded(digest: Column, proof: str = "proof") -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, digest, lambda below, step: _parent(step.left, below, step.right))


def proof_digest(proof: str = "proof") -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step.left, step.right)), ""), 256)


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of docs, checked against documents of which every second (by crc32 of the id) has lost its line breaks: doc_id, leaf,
    subroot, root, proof_sha256, and what the changed leaf folds to and whether that is the root."""
    lost = (F.crc32(id_text(F.col("doc_id")).cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    claimed = F.when(lost, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf())
    rows = manifest(leaves(docs.withColumn("doc_id", F.col("doc_id").cast("long")), claimed=claimed))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.col("claimed")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
