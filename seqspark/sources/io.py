"""Readers of labelled releases and captured groups; writers of scores, shifts, features, models and histories."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqspark.sources.tables import HAND

RELEASE = T.StructType([
    T.StructField("release", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("split", T.StringType()),
        T.StructField("chunks", T.ArrayType(T.ArrayType(HAND))),
        T.StructField("groundTruth", T.ArrayType(T.IntegerType())),
        T.StructField("groupIds", T.ArrayType(T.StringType())),
    ]))),
])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local session may have it anywhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows reads it, and a lost executor costs nothing that came before."""
    path = scratch(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_releases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled groups -> group_id, release, split, label, hands. Groups and labels are paired by place; those without either are left out.

    One JSON file a release, its stem the release's name, is read whole by one task. With ``lines`` there are files of any number in folders, with a
    document a line that names its release (``write_releases``), and they are split among tasks at any size. Groups are named by release, part
    and place where the document does not name them."""
    files = spark.read.schema(RELEASE).option("multiLine", not lines).option("recursiveFileLookup", lines).json(path).withColumn("file", F.input_file_name())
    release = F.col("release") if lines else F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    parts = files.select(release.alias("release"), F.posexplode("chunks").alias("part", "c"))
    paired = F.arrays_zip(F.col("c.chunks").alias("hands"), F.col("c.groundTruth").alias("label"))
    rows = parts.select("release", "part", F.coalesce("c.split", F.lit("train")).alias("split"), F.col("c.groupIds").alias("ids"), F.posexplode(paired).alias("place", "g"))
    rows = rows.where("g.hands IS NOT NULL AND g.label IS NOT NULL")
    name = F.coalesce(F.get("ids", F.col("place")), F.concat_ws("/", "release", "part", "place"))
    return rows.select(name.alias("group_id"), "release", "split", F.col("g.label").alias("label"), F.col("g.hands").alias("hands"))


def write_releases(groups: DataFrame, path: str) -> None:
    """Labelled groups (group_id, release, split, label, hands) as JSON lines in a folder a release, a group a line: no shuffle, and files that split."""
    one = F.struct(
        "split", F.array("hands").alias("chunks"), F.array(F.col("label").cast("int")).alias("groundTruth"), F.array(F.col("group_id").cast("string")).alias("groupIds")
    )
    groups.select("release", F.to_json(F.struct("release", F.array(one).alias("chunks"))).alias("value")).write.mode("overwrite").partitionBy("release").text(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captured groups: a list of hands, or an object with it under hands or chunk. Empty ones are left out. -> group_id (the file's stem), hands"""
    hands = T.ArrayType(HAND)
    wrapped = T.StructType([T.StructField("hands", hands), T.StructField("chunk", hands)])
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", hands))
    inner = F.when(F.ltrim("value").startswith("{"), F.from_json("value", wrapped))
    rows = text.select(stem.alias("group_id"), F.coalesce(bare, inner["hands"], inner["chunk"]).alias("hands"))
    return rows.where(F.size("hands") > 0)


def write_features(features: DataFrame, path: str) -> None:
    """A feature table, partitioned by release so that splits by release prune files."""
    features.write.mode("overwrite").partitionBy("release").parquet(path)


def cached_features(spark: SparkSession, path: str, build) -> DataFrame:
    """The feature table at path; built and written there if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        write_features(build(), path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Scores, shift vectors, metrics, tuned parameters, decisions: Parquet, replaced or appended to."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def write_model(model: PipelineModel, path: str, kind: str, columns: list[str], threshold: float, weights: dict[str, float]) -> None:
    """A fitted pipeline, and a row of what it takes to serve it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    schema = "kind string, columns array<string>, threshold double, weights map<string,double>"
    spark.createDataFrame([(kind, columns, threshold, weights)], schema).write.mode("overwrite").json(f"{path}/serving")


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/serving").first().asDict(recursive=True)
