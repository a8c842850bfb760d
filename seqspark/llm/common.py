"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 class for the words that most contracts use: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Application -> its temporary folder, for local sessions that name none.
_LOCAL: dict[str, str] = {}
#: Table made by cut -> its folder.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without the setting gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[application]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: what follows no longer depends on how it was made,
    and a lost executor costs no recomputation beyond it. Each call writes a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables made by cut. Only for those that nothing reads any more: what was made of them is written too."""
    for table in tables:
        path = None if table is None else _FOLDERS.pop(table, None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out again if the input has fewer splits than the cluster has cores (one small file); else unchanged. For tables that
    are read, not computed: counting the splits of a computed one would run its shuffles."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def id_text(doc_id: Column) -> Column:
    return doc_id.cast("string")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; false for a null id."""
    return F.coalesce(F.crc32(id_text(doc_id).cast("binary")) % 4 == 2, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
