"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

1. A source's target: its weight's share of all words, at most ``max_repeats`` times its own size; what a source
   cannot take is shared out again by weight among the others.
2. The total is cut into blocks of ``block_words`` words. Sources get whole blocks by highest quotients
   target / (2k + 1), then the shards of each source get the source's blocks the same way by their sizes.
3. In a shard the documents stand in a seeded order as one cyclic stream of words. The shard's quota of blocks is
   taken from a seeded place on; a quota above the stream's length goes round again.

Only ids and word counts are shuffled. A shard holds about ``shard_docs`` documents, so a source with a third of
all rows is as many shards as it needs. Source and shard tables have one row per source or shard.

Edge cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; a null
doc_id is placed by its text; repeated rows are separate rows with equal keys and share one place in the order (which of them comes first
does not matter, as they are equal); an empty table gives an empty result; other columns pass through
untouched unless they carry the names of the result's columns, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import WORD, cut

ADDED = ("size", "source_size", "target", "taken")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """32 hex digits from a key; the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def hex_number(digest: Column) -> Column:
    """The first 15 hex digits as a non-negative long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ord, weight and target. Sources whose fair share is above the cap
    form a prefix of the order by cap / weight; the rest share what is left by weight."""
    everything = Window.partitionBy(F.lit(1))
    by_ratio = everything.orderBy("ratio", "ord")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("ord", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(everything) - F.sum("cap").over(upto) + F.col("cap")) / (
        F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    )
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first_ratio = F.min(F.when(F.col("open"), F.struct("ratio", "ord"))).over(everything)
    levels = levels.withColumn("first", first).withColumn("at", first_ratio)
    capped = F.struct("ratio", "ord") < F.col("at")
    target = F.when(F.coalesce(capped, F.lit(True)), F.col("cap").cast("double")).otherwise(F.col("first") * F.col("weight"))
    return levels.select("source", "source_size", "n_docs", "ord", "weight", target.alias("target"))


def sainte_lague(items: DataFrame, within: Sequence[str], item: str, votes: str, seats: str, cap: str) -> DataFrame:
    """Add ``quota``: the seats of each item by highest quotients votes / (2k + 1), none above its cap; ties go to the
    lower item. A seat count differs from the exact share by at most half the number of items times that share and
    one, so only that many quotients an item are compared; the seats below are certain."""
    group = Window.partitionBy(*[F.col(c) for c in within]) if within else Window.partitionBy(F.lit(1))
    n, total = F.count("*").over(group), F.sum(votes).over(group)
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    known = items.withColumn("_share", share).withColumn("_n", n)
    ideal = F.col("_share") * F.col(seats)
    low = F.least(F.greatest(F.floor(ideal - F.col("_share") * F.col("_n") / 2 - 0.5), F.lit(0)), F.col(cap)).cast("long")
    high = F.least(F.floor(ideal + F.col("_share") * F.col("_n")) + 2, F.col(cap)).cast("long")
    known = known.withColumn("_low", low).withColumn("_high", F.when(F.col(votes) > 0, high).otherwise(F.lit(0).cast("long")))
    known = known.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    asked = known.withColumn("_k", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)).otherwise(F.array())))
    rank = F.row_number().over(group.orderBy(F.desc(F.col(votes) / (F.col("_k") * 2 + 1)), F.col(item), F.col("_k")))
    won = asked.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    keys = [*within, item]
    won = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    out = known.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_share", "_n", "_low", "_high", "_left", "_won")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 32,
    shard_docs: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, digest (of the text), size, source_size, target, taken (see the module)."""
    digest = text_digest(F.col("text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), digest))
    ids = cut(docs.select("doc_id", "source", seeded(key, seed).alias("key"), digest.alias("digest"), word_count(F.col("text")).alias("size")))

    sizes = ids.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = source_targets(sizes, weights, max_repeats)
    total = Window.partitionBy(F.lit(1))
    sources = sources.withColumn("seats", F.floor(F.sum("source_size").over(total) / block_words + 0.5).cast("long"))
    sources = sources.withColumn("cap", F.floor(F.col("source_size") * max_repeats / block_words).cast("long"))
    sources = sainte_lague(sources, [], "ord", "target", "seats", "cap").withColumnRenamed("quota", "blocks")
    sources = sources.withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    sources = cut(sources.select(F.col("source").alias("_source"), "ord", "source_size", "target", "blocks", "n_shards"))

    placed = ids.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", hex_number(F.col("key")) % F.col("n_shards"))
    shards = placed.groupBy("ord", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("seats"))
    shards = shards.withColumn("cap", F.floor(F.col("words") * max_repeats / block_words).cast("long"))
    shards = sainte_lague(shards, ["ord"], "shard", "words", "seats", "cap").drop("seats", "cap")
    start = hex_number(F.md5(F.concat_ws(":", F.lit(seed), F.col("ord"), F.col("shard")))) % F.greatest(F.col("words"), F.lit(1))
    shards = shards.withColumn("start", start)

    stream = Window.partitionBy("ord", "shard").orderBy("key", "size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(stream)).join(shards, ["ord", "shard"])
    begin, end, words, start = F.col("end") - F.col("size"), F.col("end"), F.col("words"), F.col("start")
    length = F.col("quota") * block_words
    rounds = F.when(words > 0, F.floor(length / words)).otherwise(F.lit(0)).cast("long")
    rest = length - rounds * words
    zero = F.lit(0).cast("long")
    overlap = F.greatest(zero, F.least(end, start + rest) - F.greatest(begin, start))
    overlap = overlap + F.greatest(zero, F.least(end, start + rest - words) - begin)
    taken = F.when(F.col("size") > 0, rounds * F.col("size") + overlap).otherwise(zero)
    return placed.select("doc_id", "source", "digest", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of which the mix takes words, with the columns in ADDED. Rows that agree in id, source and text are
    numbered, so that each gets the words of one place in the stream."""
    def numbered(df: DataFrame, id_col: str, *order: str) -> DataFrame:
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(id_col, "_source", "_digest").orderBy(*order)))

    rows = docs.drop(*ADDED).withColumns({"_source": F.col("source"), "_digest": text_digest(F.col("text"))})
    rows = numbered(rows, "doc_id", "doc_id")
    taken = mix(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("digest").alias("_of"), *ADDED)
    taken = taken.withColumns({"_source": F.col("_from"), "_digest": F.col("_of")})
    taken = numbered(taken, "_id", "taken").select("_id", "_from", "_of", F.col("_at").alias("_place"), *ADDED)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from"))
    same = same & (F.col("_digest") == F.col("_of")) & (F.col("_at") == F.col("_place"))
    return rows.join(taken.where("taken > 0"), same).drop("_id", "_from", "_of", "_source", "_digest", "_at", "_place")
