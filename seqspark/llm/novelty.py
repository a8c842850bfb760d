"""Secrets by patterns and by novelty.

Three patterns find the usual forms. Beyond them, strings that follow a sensitive word are measured: how many bytes a candidate adds to the
zstandard frame of the text around it, with a dictionary primed by the words of the whole corpus. What the text and the dictionary
explain adds little; a random string adds most of its length and is reported as ``novel``.

Spans are in code points, end exclusive. Edge cases: null and empty texts have no spans; texts are searched whole; of equal spans each kind
counts; repeated rows are separate rows; an empty table gives none; other columns are left out. The dictionary has at most DICTIONARY_WORDS
words, counted over all documents; a candidate's own copies in the text around it explain nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import spread

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Shortest match of a kind (of an assignment: of its value).
LEAST = {"assign": 6, "access": 20, "hex": 24}

SENSITIVE = re.compile(r"(?:passphrase|passw(?:or)?d|passwd|pwd|secret|token|credential|api.?key|access.?key|private.?key|auth|bearer|signature|session)", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Code points after a sensitive word within which a candidate begins, and those of text on either side that it is measured against.
REACH, AROUND = 48, 600
#: Bytes that a candidate adds, per byte of its own, from which it counts as incompressible.
NOVELTY = 0.75
DICTIONARY_WORDS, LEVEL = 8192, 12

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """The words and parts of identifiers (4 to 24 letters, lower case) that save most by count and length over all documents, the best last. What
    has digits is left out with all its parts, so that a secret that is copied often does not explain itself. Of bounded size: ``words`` words."""
    tokens = spread(docs.select(F.col("text").cast("string").alias("text"))).select(F.explode(F.split("text", "[^A-Za-z0-9]+")).alias("token"))
    plain = tokens.where(~F.col("token").rlike("[0-9]")).select(F.explode(F.split("token", "(?<=[a-z])(?=[A-Z])")).alias("word"))
    counts = plain.select(F.lower("word").alias("word")).where(F.length("word").between(4, 24)).groupBy("word").agg(F.count("*").alias("n"))
    best = counts.where("n > 1").orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(words)
    return " ".join(r["word"] for r in reversed(best.collect())).encode()


class Meter:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, primed: bytes):
        of = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        shared = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primed) >= 8 else None
        if shared:
            shared.precompute_compress(compression_params=of)
        self._frames = zstandard.ZstdCompressor(compression_params=of, dict_data=shared)

    def added(self, before: str, candidate: str, after: str) -> int:
        """Bytes that the candidate adds to the text around it, which is freed of the candidate's copies. Case tells nothing."""
        before, candidate, after = before.lower(), candidate.lower(), after.lower()
        before, after = before.replace(candidate, ""), after.replace(candidate, "")
        around = len(self._frames.compress(f"{before} {after}".encode(errors="surrogatepass")))
        return len(self._frames.compress(f"{before}{candidate}{after}".encode(errors="surrogatepass"))) - around


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of what the patterns find."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        out += [(*m.span(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[KINDS[kind]]]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, int]], meter: Meter) -> list[tuple[int, int, int]]:
    """Incompressible strings after sensitive words, but for those that meet a span already found."""
    out: list[tuple[int, int, int]] = []
    known = sorted(taken)
    seen = -1
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, word.end()):
            start, end = m.span()
            if start > word.end() + REACH:
                break
            if start <= seen:
                continue
            seen = start
            if any(a < end and start < b for a, b, _ in known):
                continue
            added = meter.added(text[max(0, start - AROUND) : start], m[0], text[end : end + AROUND])
            if added >= NOVELTY * (end - start):
                out.append((start, end, 3))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def scan(docs: DataFrame, primed: bytes | None = None) -> DataFrame:
    """doc_id, counts and digest of what the patterns find, all spans (``kind:start:end``, by start, then kind), n_novel. Without a dictionary one is
    made of docs."""
    primed = dictionary(docs) if primed is None else primed

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(primed)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = novel_spans(text or "", base, meter)
                counts = [sum(s[2] == k for s in base) for k in range(3)]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [c.split()[0] for c in SCHEMA.split(", ")])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(found, SCHEMA)
