"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps, per document, the measurements and one long of failure bits; a policy is
a version and a mask of the rules that it heeds, so another policy or an ablation needs the bits alone and no text.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null and empty texts have no words and fail the rule on length; equal
lines count from their second on, lines without a word never; repeated rows are separate rows; an empty table
gives an empty ledger; other columns are left out of the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm import textnp
from seqspark.llm.common import spread

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")

#: Name and failing condition of each rule; bit i is rule i.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("many_words", "n_words > 100000"),
    ("shouting", "2 * n_upper > n_letters"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
ALL = (1 << len(RULES)) - 1

#: Version -> mask of the rules that decide.
POLICIES = {"base": BASE, "v1": BASE | BITS["symbols"] | BITS["duplicate_lines"], "v2": ALL}

_SYMBOLS, _UPPER, _LETTERS, _LINES = (np.zeros(256, bool) for _ in range(4))
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTERS[65:91] = _LETTERS[97:123] = True
_LINES[10] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text of a slice."""
    n = len(offsets) - 1
    starts, ends, first = textnp.words(data, offsets)
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": _per_text(lead & ~textnp.SPACES[data], offsets)}
    out["n_symbols"] = _per_text(_SYMBOLS[data], offsets)
    out |= {"n_letters": _per_text(_LETTERS[data], offsets), "n_upper": _per_text(_UPPER[data], offsets)}

    line_starts, line_ends, _ = textnp.words(data, offsets, _LINES)
    text_of_line = np.searchsorted(offsets, line_starts, "right") - 1
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, text_of_line = line_starts[worded], line_ends[worded], text_of_line[worded]
    keys = textnp.mixed(textnp.word_hashes(data, line_starts, line_ends) + text_of_line.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    out["n_lines"] = np.bincount(text_of_line, minlength=n)
    _, kept = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text_of_line[kept], minlength=n)

    runs = textnp.run_hashes(textnp.word_hashes(data, starts, ends), 5)
    text_of_word = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(text_of_word[: len(runs)] == text_of_word[4:]) if len(runs) else np.zeros(0, np.int64)
    again = at[_repeats(textnp.mixed(runs[at] + text_of_word[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))]
    cover = np.zeros(len(starts) + 1, np.int32)
    cover[again] += 1
    np.subtract.at(cover, again + 5, 1)
    out["n_repeat_words"] = np.bincount(text_of_word[np.cumsum(cover[:-1]) > 0], minlength=n) if n else n_words
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failures (a long of bits; 1 << i: rule i fails)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textnp.slices(batch.column("text")):
                found = measure(data, offsets)
                arrays = [batch.column("doc_id").slice(i, j - i), *[pa.array(found[m].astype(np.int64)) for m in MEASURES]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *MEASURES])

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    rows = spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(measured, schema)
    failed = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    bits = failed[0]
    for more in failed[1:]:
        bits = bits.bitwiseOR(more)
    return rows.withColumn("failures", bits.cast("long"))


def passes(mask: int, failures: Column | str = "failures") -> Column:
    """Whether a document fails none of the rules in the mask."""
    return F.col(failures).bitwiseAND(F.lit(mask)) == 0 if isinstance(failures, str) else failures.bitwiseAND(F.lit(mask)) == 0


def ablations(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """For each policy, and for it without each of its rules: version, without (null: none), n_docs, n_kept. The ledger
    is summed to one row per pattern of bits first, so its size does not matter to the rest."""
    patterns = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [(v, None, m) for v, m in policies.items()]
    cases += [(v, name, m & ~bit) for v, m in policies.items() for name, bit in BITS.items() if m & bit]
    masks = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(w).cast("string").alias("without"), F.lit(m).alias("mask")) for v, w, m in cases]))
    held = patterns.withColumn("case", masks)
    kept = F.when(F.col("failures").bitwiseAND(F.col("case.mask")) == 0, F.col("n")).otherwise(0)
    return held.groupBy("case.version", "case.without").agg(F.sum("n").alias("n_docs"), F.sum(kept).alias("n_kept"))


def verdicts(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    rows = ledger(docs).withColumn("base_failed", ~passes(BASE))
    return rows.withColumn("kept", ~F.col("base_failed") & passes(POLICIES[version]))
