"""Parquet tables of a data folder, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, with only the named columns if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table comes in fewer pieces than there are (small files of one row group); larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a session of one machine may leave it unset; then a temporary one is made."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    own = sc.getConf().get("spark.checkpoint.dir")
    if not own and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="attestant-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows once, as Parquet in the shared folder, and reads them from there: later passes take only the columns they need and
    survive lost executors. The files go when the application ends.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)
