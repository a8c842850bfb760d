"""Sequences and score tables over the given tables of events, orders and vectors: what the registered queries read.

``hourly``: a hand is an hour of events, a group a day. ``short``: a hand is two events, a group a hundred hands. ``customers``: a hand is an
order, a group a customer. ``scored``: a row a vector, with four part scores. Amounts are whole cents or units, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.operators.hands import KEYS
from seqspark.sources.tables import Sequences

EVENT_ACTIONS = {"click": "check", "view": "call", "signup": "fold", "purchase": "bet", "error": "raise"}
LINE_ACTIONS = {"AF": "check", "AO": "call", "NF": "fold", "NO": "bet", "RF": "raise", "RO": "call"}
STREETS = ("preflop", "flop", "turn", "river")
PARTS = ("stack", "mono", "mlp", "drse")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession, rows: DataFrame, per_part: int = 250_000) -> int:
    """How many partitions rows are dealt to, so that what a task holds does not grow with the table; a count of Parquet reads its footers only."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_part))


def _map(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _sequences(rows: DataFrame) -> Sequences:
    """rows: group_id, hand_id, action_idx, seat, hero_seat, action_type, street_no, cents, value (of the event)."""
    hand = Window.partitionBy(*KEYS).orderBy("action_idx")
    rows = rows.withColumn("after", F.sum("cents").over(hand.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("street", F.element_at(F.array(*[F.lit(s) for s in STREETS]), F.col("street_no") + 1))
    amount = F.col("cents") / 100
    actions = rows.select(
        *KEYS, "action_idx", "seat", "action_type", "street", amount.alias("amount"), (amount / 10).alias("norm_bb"), ((F.col("after") - F.col("cents")) / 100).alias("pot_before"),
        (F.col("after") / 100).alias("pot_after"), F.when(F.col("action_type") == "raise", amount).alias("raise_to"), F.when(F.col("action_type") == "call", amount).alias("call_to"),
    )
    players = rows.groupBy(*KEYS, "seat").agg((F.max("value") * 10).alias("starting_stack")).withColumn("player_uid", F.col("seat").cast("string"))
    last = lambda c: F.max_by(c, "action_idx")
    hands = rows.groupBy(*KEYS).agg(
        F.first("hero_seat").alias("hero_seat"), F.countDistinct("seat").cast("int").alias("n_players"), F.max(F.when(F.col("seat") == F.col("hero_seat"), F.col("value") * 10)).alias("hero_stack"),
        last("seat").alias("winner"), (last("after") / 100).alias("total_pot"), (last("street_no") == 3).alias("_river"), (last("action_type") != "fold").alias("_stays"),
        F.countDistinct(F.when(F.col("street_no") > 0, F.col("street_no"))).cast("int").alias("n_board_streets"),
        F.array_join(F.array_sort(F.collect_set(F.concat(F.col("street_no").cast("string"), F.substring("street", 1, 1)))), "").alias("shape"),
    )
    hands = hands.select(
        *KEYS, "hero_seat", F.lit(10.0).alias("bb"), F.lit(0).alias("button_seat"), "n_players", F.coalesce("hero_stack", F.lit(0.0)).alias("hero_stack"),
        (F.col("winner") == F.col("hero_seat")).alias("won"), "total_pot", (F.col("_river") & F.col("_stays")).alias("showdown"), "n_board_streets",
        F.regexp_replace("shape", "[0-9]", "").alias("street_shape"),
    )
    return Sequences(actions, hands, players)


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = _map(EVENT_ACTIONS, F.col("event_type"))
    cents = F.when(action.isin("call", "bet", "raise"), F.round(F.col("value") * 100).cast("long")).otherwise(F.lit(0).cast("long"))
    stamp = F.col("ts").cast("string")
    return e.select(
        "event_id", "value", (F.col("user_id") % 6).cast("int").alias("seat"), action.alias("action_type"), F.floor(F.minute("ts") / 15).cast("int").alias("street_no"),
        cents.alias("cents"), F.substring(stamp, 1, 10).alias("day"), F.substring(stamp, 1, 13).alias("hour"), F.dayofmonth("ts").alias("day_no"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> Sequences:
    rows = _event_rows(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("day", "hour").orderBy("event_id"))
    rows = rows.withColumn("action_idx", place).withColumn("hero_seat", (F.col("day_no") % 6).cast("int"))
    return _sequences(rows.withColumnsRenamed({"day": "group_id", "hour": "hand_id"}))


def hourly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, label, release (the week)."""
    days = table(spark, sf_dir, "events").select(F.substring(F.col("ts").cast("string"), 1, 10).alias("group_id")).distinct()
    week = F.date_format(F.date_trunc("week", F.to_date("group_id")), "yyyy-MM-dd")
    return days.select("group_id", (F.dayofmonth(F.to_date("group_id")) % 2).alias("label"), week.alias("release"))


def short(spark: SparkSession, sf_dir: str, events: int = 200) -> Sequences:
    """Groups of so many events."""
    rows = _event_rows(spark, sf_dir).withColumn("group_id", F.floor(F.col("event_id") / events)).withColumn("hand_id", F.floor(F.col("event_id") / 2))
    place = F.row_number().over(Window.partitionBy("group_id", "hand_id").orderBy("event_id"))
    return _sequences(rows.withColumn("action_idx", place).withColumn("hero_seat", (F.col("group_id") % 6).cast("int")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of orders: group_id (customer), hand_id (order), action_idx, action_type, size (units, null where it does not count), release,
    label."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("hand_id"))
    lines = table(spark, sf_dir, "lineitem")
    action = _map(LINE_ACTIONS, F.concat("l_returnflag", "l_linestatus"))
    lines = lines.select(F.col("l_orderkey").alias("hand_id"), action.alias("action_type"), "l_quantity", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    n = parts_of(spark, lines)
    rows = orders.repartition(n, "hand_id").join(lines.repartition(n, "hand_id"), "hand_id")
    order = Window.partitionBy("group_id", "hand_id").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.withColumn("action_idx", F.row_number().over(order))
    size = F.when(F.col("action_type").isin("call", "bet", "raise"), F.col("l_quantity"))
    release, label = (F.lit(1995) + F.col("group_id") % 7).cast("string"), (F.col("group_id") % 2).cast("int")
    return rows.select("group_id", "hand_id", "action_idx", "action_type", size.alias("size"), release.alias("release"), label.alias("label"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, idx, batch_id, release, label, four part scores, score (their mean), tied (the score cut to twentieths)."""
    v = table(spark, sf_dir, "embeddings")
    part = lambda k: (1 / (1 + F.exp(-10 * F.col("embedding")[k].cast("double"))))
    rows = v.select(
        F.col("vec_id").alias("group_id"), F.col("vec_id").alias("idx"), (F.col("vec_id") % 5).alias("batch_id"), (F.col("vec_id") % 8).cast("string").alias("release"),
        (F.col("label") < 5).cast("int").alias("label"), *[part(k).alias(name) for k, name in enumerate(PARTS)], "embedding",
    )
    mean = sum((F.col(p) for p in PARTS), F.lit(0.0)) / len(PARTS)
    return rows.withColumn("score", F.round(mean, 9)).withColumn("tied", F.floor(F.col("score") * 20) / 20)
