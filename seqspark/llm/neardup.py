"""Near-duplicate documents by circulant MinHash, exact checks and connected components.

A document's set holds its distinct runs of ``shingle`` words (of all its words, if it has fewer). Two permutations of
the 32-bit numbers make the whole signature: the first scatters the set, and coordinate k is the smallest value of the
second one at the scattered elements shifted circularly by k. Bands of ``rows`` coordinates give the candidates: two
sets of similarity s meet in no band with a chance of (1 - s**rows)**bands, 7e-8 at 0.8 with 54 bands of 6.

Documents with equal sets are one class. In each bucket of a band the classes are compared with one of them (another in
each band), on their full sets; what is linked forms components. Only pairs of a bucket that lie in different components are
left: of a bucket's members, those outside its largest component have to meet the others. Both are cut into blocks of about ``BLOCK``, and each
pair of blocks is compared inside a task: first by set sizes and sketches (a byte of each coordinate; a pair at the threshold agrees in fewer than the asked share with a chance of 1e-7), each
pair in the first band that it shares; then what is left, on full sets, until their components are joined. Rows are
members, never pairs, and tasks hold two blocks, so a group of thousands of near copies costs no more than its members' sets in a
few blocks, and no link between components is lost.

Edge cases: null and empty texts and texts without words have an empty set and are linked with nothing; rows of equal
doc_id are one document whose links are united; a row with a null doc_id stands alone and is kept; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import textnp
from seqspark.llm.common import cut, discard, spread
from seqspark.llm.components import connected_components

_SCATTER = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_PERMUTE = (np.uint32(0x9E3779B1), np.uint32(0x7FEB352D))
#: Elements that one pass over the coordinates holds in cache.
_BLOCK = 1 << 14
#: Members of a bucket that are compared at once with as many others.
BLOCK = 512


def _permuted(x: np.ndarray, factors: tuple[np.uint32, np.uint32], out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, from x into out."""
    np.right_shift(x, 16, out=spare)
    np.bitwise_xor(x, spare, out=out)
    np.multiply(out, factors[0], out=out)
    np.right_shift(out, 13, out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, factors[1], out=out)
    np.right_shift(out, 16, out=spare)
    np.bitwise_xor(out, spare, out=out)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    data = textnp.LOWER[data]
    starts, ends, first = textnp.words(data, offsets)
    hashes = textnp.word_hashes(data, starts, ends)
    runs = textnp.run_hashes(hashes, shingle)
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= shingle:
            out.append(np.unique(runs[i : j - shingle + 1]))
        else:
            out.append(textnp.run_hashes(hashes[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out


def circulant_minhash(elements: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """[sets, coordinates] signatures of non-empty sets that lie one after the other, set i from first[i] on."""
    out = np.full((len(first), coordinates), 0xFFFFFFFF, np.uint32)
    low = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    scattered = _permuted(low, _SCATTER, np.empty_like(low), np.empty_like(low))
    for begin in range(0, len(low), _BLOCK):
        part = scattered[begin : begin + _BLOCK]
        lo = int(np.searchsorted(first, begin, "right")) - 1
        hi = int(np.searchsorted(first, begin + len(part)))
        cuts = np.maximum(first[lo:hi] - begin, 0)
        shifted, value, spare = np.empty_like(part), np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint32(k), out=shifted)
            least = np.minimum.reduceat(_permuted(shifted, _PERMUTE, value, spare), cuts)
            np.minimum(out[lo:hi, k], least, out=out[lo:hi, k])
    return out


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, one hash for each band, and the sketch: a byte of each coordinate."""
    factors = textnp._RUN_FACTORS[:rows]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                sets = shingle_sets(data, offsets, shingle)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                first_hash, second_hash = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                keys: list = [[]] * len(sets)
                sketches = [b""] * len(sets)
                if len(full):
                    elements = np.concatenate([sets[k] for k in full])
                    first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    first_hash[full] = np.add.reduceat(textnp.mixed(elements), first)
                    second_hash[full] = np.add.reduceat(textnp.mixed(elements ^ np.uint64(0x5851F42D4C957F2D)), first)
                    values = circulant_minhash(elements, first, bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                    banded = textnp.mixed((values * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
                    low = values.reshape(len(full), -1).astype(np.uint8)
                    for k, row, coordinate in zip(full, banded, low, strict=True):
                        keys[k] = row.view(np.int64)
                        sketches[k] = coordinate.tobytes()
                arrays = [batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array(first_hash.view(np.int64)), pa.array(second_hash.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "h1", "h2", "keys", "sketch"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(signed, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sketch binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its set as bytes (64-bit hashes in order)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                sets = [x.tobytes() for x in shingle_sets(data, offsets, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, elements binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, by their full sets."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True))
            keep = [alike(x, y, percent) for x, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a pair of blocks one after the other in one partition."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", *(["asked"] if "asked" in rows.columns else []), "rep")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks, from batches in which they are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and [held[-1].column(c)[-1].as_py() for c in ("key", "i", "j")] != keys[:, 0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _likely(rows: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """The members of pairs that sizes and sketches do not rule out: key, i, j, rep, component, partners (the others of its pairs). A pair
    belongs to the first band that it shares."""
    share = percent / 100
    least = int(coordinates * (share - 5.2 * (share * (1 - share) / coordinates) ** 0.5))
    schema = "key long, i int, j int, rep long, component long, partners array<long>"

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
            rep, component, n, out, asks = (table.column(c).to_numpy() for c in ("rep", "component", "n", "out", "asked"))
            others = np.flatnonzero(~asks)
            if len(others) in (0, len(asks)):
                continue
            low = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            band = int(np.flatnonzero(keys[0] == key)[0])
            pairs: dict[int, list[int]] = {}
            for a in np.flatnonzero(asks).tolist():
                # two that both ask meet once
                b = others[(component[others] != component[a]) & (~out[others] | (rep[others] > rep[a]))]
                b = b[100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])]
                b = b[(low[b] == low[a]).sum(axis=1) >= least] if len(b) else b
                b = b[~(keys[b, :band] == keys[a, :band]).any(axis=1)] if len(b) and band else b
                if len(b):
                    pairs[a] = rep[b].tolist()
                    for x in b:
                        pairs.setdefault(int(x), [])
            if pairs:
                at = sorted(pairs)
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * m), pa.array([i] * m, pa.int32()), pa.array([j] * m, pa.int32()), pa.array(rep[at]), pa.array(component[at]), pa.array([pairs[a] for a in at], pa.list_(pa.int64()))],
                    ["key", "i", "j", "rep", "component", "partners"],
                )

    return rows.mapInArrow(ruled, schema)


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of _likely, on full sets; a pair whose components a link before has joined is passed over."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            # rows of one doc_id may have several sets
            sets: dict[int, list[np.ndarray]] = {}
            for r, e in zip(table.column("rep").to_pylist(), table.column("elements").to_pylist(), strict=True):
                sets.setdefault(r, []).append(np.frombuffer(e, np.uint64))
            component = dict(zip(table.column("rep").to_pylist(), table.column("component").to_pylist(), strict=True))
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            links = []
            for a, partners in zip(table.column("rep").to_pylist(), table.column("partners").to_pylist(), strict=True):
                for b in partners:
                    x, y = top(component[a]), top(component[b])
                    if x != y and any(alike(p, q, percent) for p in sets[a] for q in sets[b]):
                        root[max(x, y)] = min(x, y)
                        links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return rows.mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 54, rows: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is that one)."""
    signed = cut(signatures(docs, shingle, bands, rows))
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    member = cut(filled.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep"))
    placed = classes.select("rep", "h1", "h2", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))

    # of each bucket with two classes or more, one class that all others are compared with
    lowest = F.min(F.col("rep").bitwiseXOR(F.col("key")))
    buckets = placed.groupBy("key").agg(lowest.alias("low"), F.count("*").alias("size")).where("size > 1")
    buckets = buckets.select("key", F.col("low").bitwiseXOR(F.col("key")).alias("hub"))
    met = cut(placed.join(buckets, "key"))
    stars = cut(met.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())

    # their number has no bound, so they are never broadcast
    asked = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(asked.hint("merge"), "doc_id", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    sets = cut(_sets(texts, shingle))
    links = cut(_confirmed(stars, sets, percent))

    # the pairs of a bucket that are still in different components
    label = connected_components(links)
    known = met.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = cut(known.select("key", "rep", "h1", "h2", "n", F.coalesce("component", "rep").alias("component")))
    parts = known.groupBy("key", "component").agg(F.count("*").alias("c"))
    split = parts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("outside")).where("outside > 0")
    open_ = known.join(split, "key").withColumn("out", F.col("component") != F.col("main"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("h1", "h2"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    asking = open_.where("out").withColumn("i", own("outside")).withColumn("j", every("size")).withColumn("asked", F.lit(True))
    others = open_.withColumn("j", own("size")).withColumn("i", every("outside")).withColumn("asked", F.lit(False))
    open_ = asking.unionByName(others).select("key", "i", "j", "asked", "out", "rep", "h1", "h2", "n", "component")
    open_ = open_.join(classes.select("h1", "h2", "keys", "sketch"), ["h1", "h2"]).drop("h1", "h2")
    likely = cut(_likely(_together(open_), percent, bands * rows))
    asked = likely.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    more = _joined(_together(asked), percent)

    # rows of one doc_id with different sets are one document
    doubled = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    doubled = member.join(doubled, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    label = connected_components(links.unionByName(more).unionByName(doubled))
    discard(classes, met, stars, sets, links, known, likely)

    found = member.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents, one of each group of near duplicates; of rows of equal doc_id and text, one. Rows without a doc_id stay."""
    kept = near_duplicates(docs, **settings).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    chosen = chosen.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return chosen.unionByName(docs.where("doc_id IS NULL"))
