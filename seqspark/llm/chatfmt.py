"""Chat formatting of conversations as prefix trees. DataFrame functions only.

Conversations that begin with the same turns share them: each distinct beginning is a node, and the tree is emitted depth first as one stream of
tokens in which each node stands once (a token is a code point). A node has

* ``start`` and ``end`` in the stream, and ``position``, the position id of its first token: what a conversation read alone
  would give it, so siblings have equal positions;
* ``ancestors``: the intervals of the stream that its tokens may attend to besides the node itself;
* ``loss_start`` and ``loss_end``: the part of its tokens under the loss mask (an assistant's text, without the marks);
* ``shard``: the stream is cut into training files of about ``shard_tokens`` tokens, each node in that of its start. A shard may refer to
  ancestors in an earlier one.

``paths`` has each conversation's nodes and intervals in order. All of it depends on the conversations alone, not on how they are partitioned: they
are numbered in the order of their nodes, then ids, and a node is emitted by the first of its conversations.

Work is split into ``BLOCK`` conversations in that order, so a beginning that very many share is in no task as a whole. A beginning is known
by 128 bits; where a conversation meets a node, digests of their turns and the keys before them are compared, and a difference is an error.

A turn is ``<|turn|>role<|text|>text<|end|>``. Control strings in roles and texts (these marks' ``<|``, and ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) get a backslash after their first character, and one more where there are some: ``unescaped`` takes it back.

Turns are ordered by ``turn`` (nulls first), then role, then text. No conversation's texts are gathered; only its nodes' keys (16 bytes a
turn) are. Edge cases: a null role or text is an empty one; rows with a null conv_id are one conversation; repeated rows are repeated
turns; equal conversations share all nodes; an empty table gives empty results; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import cut, discard

#: Conversations that one task holds at a time; tokens of a shard.
BLOCK, SHARD_TOKENS = 1024, 1 << 24
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"(?=\||s>|/s>|INST\]|/INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(role), F.lit(TEXT), escaped(text), F.lit(END))


def parsed(turn: Column) -> tuple[Column, Column]:
    """(role, text) of a formatted turn."""
    at = F.locate(TEXT, turn)
    role = turn.substr(F.lit(len(TURN) + 1), at - len(TURN) - 1)
    text = turn.substr(at + len(TEXT), F.length(turn) - at - len(TEXT) - len(END) + 1)
    return unescaped(role), unescaped(text)


@dataclass
class PrefixTree:
    """nodes: shard, start, end, position, depth, role, text (formatted), loss_start, loss_end, ancestors.
    paths: conv_id, block, n_turns, nodes (their starts in order), intervals (the same, adjacent ones joined)."""

    nodes: DataFrame
    paths: DataFrame


def _intervals(nodes: Column) -> Column:
    """Adjacent (start, end) joined."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        follows = (F.size(done) > 0) & (last["end"] == x["start"])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end"))))
        return F.when(follows, longer).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))).cast(kind)

    return F.aggregate(nodes, F.array().cast(kind), add)


def prefix_tree(conversations: DataFrame, shard_tokens: int = SHARD_TOKENS) -> PrefixTree:
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = clean.withColumn("depth", F.row_number().over(order))
    # a beginning's key: 128 bits over its turns with their places
    for name, salt in (("k1", 1), ("k2", 2)):
        turns = turns.withColumn(name, F.bit_xor(F.xxhash64(F.lit(salt), "depth", "role", "text")).over(upto))
    turns = turns.withColumn("turn_text", formatted(F.col("role"), F.col("text")))
    turns = turns.withColumn("length", F.length("turn_text").cast("long"))
    turns = turns.withColumn("position", F.sum("length").over(upto) - F.col("length"))
    # what tells a turn and its beginning from all others: its own digest and the key before it
    before = F.concat_ws(" ", F.lag("k1").over(order), F.lag("k2").over(order), "depth")
    turns = turns.withColumn("proof", F.unhex(F.sha2(F.concat(before, F.lit(" "), F.col("turn_text")), 256)))
    turns = cut(turns.select("conv_id", "depth", "k1", "k2", "proof", "role", "turn_text", "length", "position"))

    # depth-first order: conversations sorted by their nodes, numbered over all partitions
    keys = F.transform(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2"))), lambda x: F.struct(x["k1"], x["k2"]))
    placed = turns.groupBy("conv_id").agg(keys.alias("path")).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    at = F.monotonically_increasing_id()
    placed = cut(placed.select(F.col("conv_id").alias("_conv"), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("within")))
    parts = _running(placed.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    rank = F.col("within") + F.col("before")
    placed = placed.join(F.broadcast(parts), "part").select("_conv", rank.alias("rank"), F.floor(rank / BLOCK).alias("block"))
    all_turns = turns.join(placed, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    all_turns = cut(all_turns)

    # each node once, by the first conversation that has it
    in_block = all_turns.groupBy("block", "k1", "k2").agg(F.min("rank").alias("rank"))
    first = in_block.groupBy("k1", "k2").agg(F.min("rank").alias("rank"))
    emitted = all_turns.join(first, ["k1", "k2", "rank"])
    stream = Window.partitionBy("block").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    emitted = cut(emitted.withColumn("end", F.sum("length").over(stream)))
    blocks = _running(emitted.groupBy("block").agg(F.sum("length").alias("n")), "block", "n")
    emitted = emitted.join(blocks, "block").withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("length")).drop("before")

    where = emitted.select("k1", "k2", "start", "end", F.col("proof").alias("proved"))
    where = in_block.select("block", "k1", "k2").join(where, ["k1", "k2"])
    steps = all_turns.select("conv_id", "depth", "block", "k1", "k2", "proof").join(where, ["block", "k1", "k2"])
    same = F.when(F.col("proof") == F.col("proved"), F.col("start")).otherwise(F.raise_error(F.lit("two beginnings have one key")).cast("long"))
    steps = steps.withColumn("start", same)
    paths = steps.groupBy("conv_id", "block").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("depth", "start", "end"))).alias("steps"))
    paths = paths.select("conv_id", "block", "n_turns", F.transform("steps", lambda x: x["start"]).alias("nodes"), _intervals(F.col("steps")).alias("intervals"))
    paths = cut(paths)
    discard(turns, all_turns)

    own = paths.select(F.col("conv_id").alias("_conv"), F.col("intervals"))
    nodes = emitted.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")))
    before = lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], F.col("start")).alias("end"))
    # the path of the conversation that emits a node, up to the node; what is emitted later stands behind it
    ancestors = F.transform(F.filter("intervals", lambda x: x["start"] < F.col("start")), before)
    is_loss = F.col("role") == "assistant"
    loss_start = F.col("start") + F.locate(TEXT, F.col("turn_text")) - 1 + len(TEXT)
    loss_end = F.col("end") - len(END)
    nodes = nodes.select(
        F.floor(F.col("start") / shard_tokens).alias("shard"), "start", "end", "position", "depth", "role", F.col("turn_text").alias("text"),
        F.when(is_loss, loss_start).alias("loss_start"), F.when(is_loss, loss_end).alias("loss_end"), ancestors.alias("ancestors"),
    )
    return PrefixTree(nodes, paths)


def _running(table: DataFrame, order: str, value: str) -> DataFrame:
    """order, before: the sum of value over the rows before, for a table of one row a partition or block, whose rows one task holds."""
    upto = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.select(order, (F.sum(value).over(upto) - F.col(value)).alias("before"))


def read_back(tree: PrefixTree) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the stream and the paths."""
    steps = tree.paths.select("conv_id", "block", F.posexplode("nodes").alias("place", "start"))
    # a node goes once to each block that has it, so one that very many conversations share meets them in many tasks
    asked = steps.select("block", "start").distinct()
    nodes = asked.join(tree.nodes.select("start", "end", "text", "loss_start", "loss_end"), "start")
    met = steps.join(nodes, ["block", "start"])
    role, text = parsed(F.col("text"))
    masked = F.col("text").substr((F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    met = met.select(
        "conv_id", "place", F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("said"),
        F.coalesce(unescaped(masked), F.lit("")).alias("lost"), (F.col("end") - F.col("start")).alias("length"),
    )
    joined = lambda name: F.array_join(F.transform("steps", lambda x: x[name]), "")
    whole = met.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "said", "lost"))).alias("steps"), F.sum("length").alias("formatted_chars")
    )
    return whole.select(
        "conv_id", F.size("steps").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("lost")).cast("long").alias("loss_chars"), F.sha2(joined("lost"), 256).alias("loss_sha256"), "formatted_chars",
    )
