"""Token counts that follow edits.

Each document keeps the pre-tokens of a public byte-level vocabulary in a segment tree: its leaves are the pre-tokens' characters and tokens, each
node has the sums and the number of the leaves below it, and a node has up to ``2 * FAN`` children, so finding, changing, inserting and
removing leaves all take a time that grows with the logarithm of their number. An edit (delete ``delete`` characters at ``start``, insert
``insert``) finds its pre-tokens by descending the tree. Only they are cut and counted again, from the last pre-token before them that the edit
cannot reach until a border of the old ones is met again; then the sums above the changed leaves are updated.

``kept_trees`` makes a table of texts with their leaves, and ``apply_edits`` applies a table of edits to it: documents without edits pass
through as they are, and those with some are not encoded again but where they change.

The vocabulary is a file of the driver (a parameter, never part of this library); its bytes are broadcast. A worker keeps the
token counts of about ``CACHE`` pre-tokens.

Edge cases: null counts as an empty text; an edit's start and length are cut to the text; a null insert is empty, a null array no edits, a null edit is skipped;
edits of one document are applied by ``seq`` (ties by start, delete, insert), those of documents that are not there change nothing; repeated rows are
counted alike and edited alike; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that the vocabulary is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000
#: Children of a new node; a node with more than twice as many is split.
FAN = 64


class _Node:
    """The sums of the leaves below: length (characters), tokens, n. Either parts (nodes) or lengths and counts (leaves)."""

    __slots__ = ("length", "tokens", "n", "parts", "lengths", "counts")

    def __init__(self, parts: list[_Node] | None, lengths: list[int] | None = None, counts: list[int] | None = None) -> None:
        self.parts, self.lengths, self.counts = parts, lengths, counts
        self.sum_up()

    def sum_up(self) -> None:
        if self.parts is None:
            self.length, self.tokens, self.n = sum(self.lengths), sum(self.counts), len(self.lengths)
        else:
            self.length, self.tokens, self.n = (sum(getattr(p, k) for p in self.parts) for k in ("length", "tokens", "n"))

    def split(self) -> list[_Node]:
        """This node, or several of about FAN children where it has too many; none where it has none."""
        own = self.lengths if self.parts is None else self.parts
        if len(own) <= 2 * FAN:
            return [self] if own else []
        cuts = range(0, len(own), FAN)
        if self.parts is None:
            return [_Node(None, self.lengths[i : i + FAN], self.counts[i : i + FAN]) for i in cuts]
        return [_Node(self.parts[i : i + FAN]) for i in cuts]

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> list[_Node]:
        """The nodes that stand for this one when its leaves from first to last are replaced."""
        if self.parts is None:
            self.lengths[first:last], self.counts[first:last] = lengths, counts
        else:
            before, i = 0, 0
            while i + 1 < len(self.parts) and before + self.parts[i].n <= first:
                before += self.parts[i].n
                i += 1
            new, j, at = [], i, before
            while j < len(self.parts) and (j == i or at < last):
                part, n = self.parts[j], self.parts[j].n
                new += part.replace(max(first - at, 0), min(last - at, n), lengths if j == i else [], counts if j == i else [])
                at += n
                j += 1
            self.parts[i:j] = new
        self.sum_up()
        return self.split()


class SegmentTree:
    """Leaves (length, tokens) in order under sums."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        level = [_Node(None, lengths[i : i + FAN], counts[i : i + FAN]) for i in range(0, len(lengths), FAN)]
        self.root = self._top(level)

    @staticmethod
    def _top(level: list[_Node]) -> _Node:
        while len(level) > 1:
            level = [_Node(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else _Node(None, [], [])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds the place-th character, sum of the lengths before it)"""
        node, leaf, before = self.root, 0, 0
        while node.parts is not None:
            for part in node.parts:
                if place - before < part.length or part is node.parts[-1]:
                    node = part
                    break
                leaf += part.n
                before += part.length
        for length in node.lengths:
            if place - before < length:
                break
            leaf += 1
            before += length
        return leaf, before

    def length_of(self, leaf: int) -> int:
        node = self.root
        while node.parts is not None:
            for part in node.parts:
                if leaf < part.n:
                    node = part
                    break
                leaf -= part.n
        return node.lengths[leaf]

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        self.root = self._top(self.root.replace(first, last, lengths, counts))

    def leaves(self) -> tuple[list[int], list[int]]:
        lengths, counts, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            if node.parts is None:
                lengths += node.lengths
                counts += node.counts
            else:
                stack += node.parts[::-1]
        return lengths, counts


class CountedText:
    """A text with its pre-tokens' tree, made of its leaves where they are known."""

    def __init__(self, text: str, pattern: regex.Pattern, count: Callable[[list[str]], list[int]], leaves: tuple[list[int], list[int]] | None = None) -> None:
        self.text, self._pattern, self._count, self.recounted = text, pattern, count, 0
        if leaves is None:
            self._build()
        else:
            self.tree = SegmentTree(*leaves)

    def _build(self) -> None:
        pieces = self._pattern.findall(self.text)
        self.tree = SegmentTree(list(map(len, pieces)), self._count(pieces))

    @property
    def n(self) -> int:
        return self.tree.root.n

    def _from(self, at: int, met: Callable[[int], bool]) -> tuple[list[str], int]:
        """(pre-tokens from a border on, where they end): to the end of the text or the first border that is met."""
        pieces = []
        while at < len(self.text):
            m = self._pattern.match(self.text, at)
            pieces.append(m.group())
            at = m.end()
            if met(at):
                break
        return pieces, at

    @property
    def tokens(self) -> int:
        return self.tree.root.tokens

    def edit(self, start: int, delete: int, insert: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(start + max(delete, 0), size)
        old, tree = self.text, self.tree
        self.text = old[:start] + insert + old[end:]
        if not self.n:
            self._build()
            self.recounted += self.n
            return
        # one whole pre-token of context, and no white space before it that could reach the edit
        leaf, at = tree.find(min(max(start - 1, 0), size - 1))
        steps = 1
        while leaf > 0 and (steps > 0 or old[at : at + tree.length_of(leaf)].isspace()):
            leaf -= 1
            at -= tree.length_of(leaf)
            steps -= 1
        # old borders after the edit, in the new text's places
        shift = len(insert) - (end - start)
        last, border = tree.find(min(end, size - 1))
        state = [last, border]

        def met(place: int) -> bool:
            while state[0] < self.n and (state[1] < end or state[1] + shift < place):
                state[1] += tree.length_of(state[0])
                state[0] += 1
            return state[1] >= end and state[1] + shift == place

        pieces, stop = self._from(at, met)
        past = state[0] if stop < len(self.text) or met(stop) else self.n
        self.recounted += len(pieces)
        tree.replace(leaf, past, [len(p) for p in pieces], self._count(pieces))


def counter(vocabulary: bytes) -> tuple[regex.Pattern, Callable[[list[str]], list[int]]]:
    """(pattern of pre-tokens, count: the numbers of tokens of pre-tokens)"""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(pieces: list[str]) -> list[int]:
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) >= CACHE:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    found[i] = known[pieces[i]] = len(encode(pieces[i]))
        return found

    return regex.compile(PATTERN), count


def count_edited(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of each text, n_tokens_edited after its edits (array of struct start, delete, insert, applied one
    after the other), n_recounted (pre-tokens counted for them)."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ("n_tokens", "n_pretokens", "n_tokens_edited", "n_recounted")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, count = counter(shared.value)
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for text, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                doc = CountedText(text.as_py() or "", pattern, count)
                out[0].append(doc.tokens)
                out[1].append(doc.n)
                for e in changes.as_py() or []:
                    if e is not None:
                        doc.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                out[2].append(doc.tokens)
                out[3].append(doc.recounted)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out]], ["doc_id", *names])

    rows = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), edits.alias("edits")))
    return rows.mapInArrow(counted, "doc_id long, " + ", ".join(f"{n} long" for n in names))


KEPT = "doc_id long, text string, n_tokens long, n_pretokens long, lengths binary, counts binary"


def _kept_row(doc: CountedText) -> tuple[str, int, int, bytes, bytes]:
    lengths, counts = doc.tree.leaves()
    return doc.text, doc.tokens, doc.n, np.array(lengths, np.int32).tobytes(), np.array(counts, np.int32).tobytes()


def kept_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, n_tokens, n_pretokens, lengths, counts (the leaves, 32-bit numbers): a table to be written and edited."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, count = counter(shared.value)
        for batch in batches:
            rows = [_kept_row(CountedText(t.as_py() or "", pattern, count)) for t in batch.column("text")]
            yield _record(batch.column("doc_id"), rows)

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(kept, KEPT)


def _record(doc_id: pa.Array, rows: list[tuple], *more: pa.Array) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    arrays = [doc_id, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)), *more]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_tokens", "n_pretokens", "lengths", "counts", *["n_recounted"][: len(more)]])


def apply_edits(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table of kept_trees after edits (doc_id, seq, start, delete, insert), with n_recounted. Only documents with edits reach Python, with
    all their edits in a row, as each edit's places are those that the one before has left."""
    with open(vocabulary, "rb") as f:
        shared = kept.sparkSession.sparkContext.broadcast(f.read())
    columns = ["doc_id", "text", "n_tokens", "n_pretokens", "lengths", "counts"]
    listed = F.array_sort(F.collect_list(F.struct("seq", "start", "delete", "insert")))
    changes = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(listed.alias("edits"))
    rows = kept.select(*columns).join(changes, "doc_id", "left")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, count = counter(shared.value)
        for batch in batches:
            rows, recounted = [], []
            for text, lengths, counts, changes in zip(*(batch.column(c) for c in ("text", "lengths", "counts", "edits")), strict=True):
                leaves = [np.frombuffer(x.as_py(), np.int32).tolist() for x in (lengths, counts)]
                doc = CountedText(text.as_py(), pattern, count, (leaves[0], leaves[1]))
                for e in changes.as_py():
                    doc.edit(e["start"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append(_kept_row(doc))
                recounted.append(doc.recounted)
            yield _record(batch.column("doc_id"), rows, pa.array(recounted, pa.int64()))

    same = rows.where("edits IS NULL").select(*columns, F.lit(0).cast("long").alias("n_recounted"))
    return same.unionByName(rows.where("edits IS NOT NULL").mapInArrow(edited, KEPT + ", n_recounted long"))


def revisions() -> Column:
    """Three edits of each text, drawn from its own doc_id and characters: a replacement, a deletion, an insertion."""
    n = F.greatest(F.length("text"), F.lit(1)).cast("long")
    draw = lambda k, below: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), below).cast("int")
    piece = lambda k: F.col("text").substr(draw(k, n) + 1, draw(k + 1, F.lit(30).cast("long")))
    edit = lambda start, delete, insert: F.struct(start.alias("start"), delete.alias("delete"), insert.alias("insert"))
    none = F.lit(0)
    return F.array(
        edit(draw(1, n), draw(2, F.lit(20).cast("long")), piece(3)),
        edit(draw(5, n), draw(6, F.lit(40).cast("long")), F.lit("")),
        edit(draw(7, n), none, piece(8)),
    )
