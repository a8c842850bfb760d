"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are lower-cased A-Z and digits, letters and everything beyond ASCII: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
The automaton holds every run of words of the items of a block. A document's words are streamed through it; at each
word the length of the longest run that ends there and occurs in an item is known. Where it reaches ``window`` words,
the last ``window`` words are an occurrence of an item window; an item of fewer words is one window as a whole.
``clean`` removes the hit words' spans, or the document where they cover too much of it.

The items are cut into blocks of about ``block_words`` words (a longer item is a block of its own), so what is broadcast has a bound
whatever the benchmark's size; a worker process builds a block's automaton once and keeps it for its other tasks. Each block is one pass
over the documents' words, and a document's passes are joined by its row before anything is decided, so results do not depend on
the blocks nor on the order of the items. No document meets another.

Edge cases: null and empty texts have no words and no hits; items without words are left out; repeated items each
count; repeated rows are separate rows; an empty benchmark hits nothing; other columns pass through ``clean`` (``_row``, ``_last`` and ``_last_row`` excepted,
which are for its own use).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, discard, spread

WINDOW = 10
BLOCK_WORDS = 200_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: One row per document and block of items.
SPANS = "row string, doc_id long, n_words long, hits array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


class SuffixAutomaton:
    """All runs of words of some items. next: transitions; link: the longest shorter suffix kept elsewhere; length: of a
    state's longest run. at_window[s]: the state of the last ``window`` words of s; items[s]: for those states, the items
    that hold the run; whole[s]: (words, item) of short items that end where s ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.window = [-1], [0], window
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.at_window = [-1] * len(self.link)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            s = 0
            for word in words:
                s = self.next[s][word]
                if self.at_window[s] >= 0:
                    self.items.setdefault(self.at_window[s], set()).add(item)
            if len(words) < window:
                self.whole.setdefault(s, []).append((len(words), item))
        for s in order:
            if above := self.whole.get(self.link[s]):
                self.whole[s] = self.whole.get(s, []) + above

    def _state(self, length: int, link: int, then: dict[bytes, int]) -> int:
        self.next.append(then)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state that follows p by word and is no longer than that."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """(ranges of hit words, items with a window in the text)"""
        step, link, lengths, at_window, whole, window = self.next, self.link, self.length, self.at_window, self.whole, self.window
        known = step[0]
        ranges: list[list[int]] = []
        found: set[str] = set()
        state = length = 0
        for i, word in enumerate(words):
            if word not in known:
                state = length = 0
                continue
            while (then := step[state].get(word)) is None:
                state = link[state]
                length = lengths[state]
            state, length = then, length + 1
            reach = 0
            if length >= window:
                found |= self.items[at_window[state]]
                reach = window
            if state in whole:
                for n, item in whole[state]:
                    if n <= length:
                        found.add(item)
                        reach = max(reach, n)
            if reach:
                first = i + 1 - reach
                while ranges and ranges[-1][0] >= first:
                    ranges.pop()
                if ranges and ranges[-1][1] >= first:
                    ranges[-1][1] = i + 1
                else:
                    ranges.append([first, i + 1])
        return ranges, found


def item_words(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode().lower())


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about block_words words; no more than a block is on the driver at a time."""
    block, size = [], 0
    for item in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = item_words(item[1])
        if words:
            block.append((str(item[0]), words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


#: The automaton that this worker process has built last, by the name of its block.
_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, block: Broadcast, window: int) -> SuffixAutomaton:
    """A block's automaton, built once a worker process, which keeps one at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = SuffixAutomaton(block.value, window)
    return _BUILT[name]


def _scanned(docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared, window)
        schema = pa.schema([
            ("row", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("hits", pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))),
            ("items", pa.list_(pa.string())),
        ])
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "hits": [], "items": []}
            for text in batch.column("text"):
                data = (text.as_py() or "").encode().lower()
                words = _WORDS.findall(data)
                ranges, found = automaton.scan(words)
                hits = []
                if ranges:
                    at = [m.span() for m in _WORDS.finditer(data)]
                    hits = [{"first": a, "last": b, "start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
                out["n_words"].append(len(words))
                out["hits"].append(hits)
                out["items"].append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(out[n], schema.field(n).type) for n in out]], schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(scan, SPANS)


def _spans(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """(row, doc_id, n_words, hits, items of docs with a column row; the written passes that they are made of)"""
    blocks = _blocks(benchmark, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    rows = docs.select(F.col("row").cast("string"), F.col("doc_id").cast("long"), "text")
    if second is None:
        return _scanned(spread(rows), first, window), []
    passes = [cut(_scanned(rows, block, window)) for block in chain([first, second], blocks)]
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    whole = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        _merged(F.array_sort(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return whole, passes


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, hits (merged ranges of hit words, with the byte range each spans in the UTF-8 text), items
    (sorted item ids). ``row`` names a column that tells rows apart and is kept; it spares a copy of the texts where the benchmark has several blocks."""
    if row is not None:
        return _spans(docs.withColumn("row", F.col(row)), benchmark, window, block_words)[0]
    one_block = next(islice(_blocks(benchmark, block_words), 1, None), None) is None
    texts = docs.select("doc_id", "text", (F.lit("") if one_block else F.uuid()).alias("row"))
    return _spans(texts if one_block else cut(texts), benchmark, window, block_words)[0].drop("row")


def _merged(hits):
    """Sorted ranges with overlapping ones joined."""
    joined = lambda done, x: F.struct(
        F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
        F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
    )
    kind = "array<struct<first:int,last:int,start:int,end:int>>"
    add = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(done, x))),
    ).otherwise(F.concat(done, F.array(x))).cast(kind)
    return F.aggregate(hits, F.array().cast(kind), add)


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contaminated_spans(docs, benchmark, **settings)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return spans.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_hits(automaton: SuffixAutomaton, text: str | None) -> tuple[str | None, float]:
    """(text without its hit spans, share of its words that were hit). What a cut brings together is scanned again."""
    left, total, hit = text, 0, 0
    while left:
        data = left.encode()
        at = [m.span() for m in _WORDS.finditer(data.lower())]
        total = total or len(at)
        ranges, _ = automaton.scan([data[a:b].lower() for a, b in at])
        if not ranges:
            break
        hit += sum(b - a for a, b in ranges)
        edges = [0, *[x for a, b in ranges for x in (at[a][0], at[b - 1][1])], len(data)]
        left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
    return left, hit / max(total, 1)


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their hit spans (from the first hit word's first byte to the last one's last); documents of which hit words
    are more than max_coverage of all words are left out. Columns and other rows stay as they are. What a cut brings together is looked at
    again, until nothing is hit."""
    if next(islice(_blocks(benchmark, block_words), 1, None), None) is None:
        return _clean_of_one(docs, next(_blocks(benchmark, block_words), []), max_coverage, window)
    # all blocks' hits of a row are known before it is cut; only rows that were cut are scanned again
    rows = cut(docs.withColumn("_row", F.uuid()))
    pending = rows.select(F.col("_row").alias("row"), "doc_id", "text", F.lit(0).cast("long").alias("hit"), F.lit(None).cast("long").alias("total"))
    rounds: list[DataFrame] = []
    while True:
        spans, passes = _spans(pending, benchmark, window, block_words)
        spans = spans.where(F.size("hits") > 0).select("row", "n_words", "hits")
        n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
        found = pending.join(spans, "row").select(
            "row", "doc_id", _without(F.col("text"), F.col("hits")).alias("text"), (F.col("hit") + n_hit).alias("hit"), F.coalesce("total", "n_words").alias("total"),
        )
        pending = cut(found)
        discard(*passes)
        if pending.isEmpty():
            break
        rounds.append(pending.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return rows.drop("_row")
    every = rounds[0]
    for one in rounds[1:]:
        every = every.unionByName(one)
    last = every.groupBy(F.col("row").alias("_last_row")).agg(F.max_by(F.struct("text", "hit", "total"), "round").alias("_last"))
    out = rows.join(last, F.col("_row") == F.col("_last_row"), "left")
    out = out.where(F.col("_last").isNull() | (F.col("_last.hit") / F.greatest("_last.total", F.lit(1)) <= max_coverage))
    text = F.when(F.col("_last").isNotNull(), F.col("_last.text")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns)


def _without(text: Column, hits: Column) -> Column:
    """A text without the byte ranges of its hits, which begin and end at borders of words and so of characters."""
    data = F.encode(text, "UTF-8")
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(hits, i - 1)["end"])
    pieces = F.transform(hits, lambda x, i: F.decode(F.substring(data, after(i) + 1, x["start"] - after(i)), "UTF-8"))
    rest = F.decode(F.substring(data, F.element_at(hits, -1)["end"] + 1, F.length(data)), "UTF-8")
    return F.concat(F.array_join(pieces, ""), rest)


def _clean_of_one(docs: DataFrame, block: list[tuple[str, list[bytes]]], max_coverage: float, window: int) -> DataFrame:
    """clean for a benchmark of one block: all rounds of a text in one place."""
    shared, name, columns = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, docs.columns

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared, window)
        at_text = columns.index("text")
        for batch in batches:
            texts, keep = [], []
            for text in batch.column(at_text):
                text, covered = without_hits(automaton, text.as_py())
                texts.append(text)
                keep.append(covered <= max_coverage)
            arrays = list(batch.columns)
            arrays[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return spread(docs).mapInArrow(cleaned, docs.schema)
