"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, a local session gets a folder of its own and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.local.dir', '/tmp')}/lintlake-shared")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lintlake-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(df: DataFrame) -> None:
    """Delete the folder of a table that stands in one; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mounted(path: str) -> str:
    """A path as the operating system has it; only folders that all machines see under one path can be walked and written."""
    plain = path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else path
    if not plain.startswith("/"):
        raise ValueError(f"not a folder that all machines have mounted: {path}")
    return plain


ROW_BITS = 33


def placed(rows: DataFrame, group: str, order: list[Column], what: str = "placed") -> DataFrame:
    """rows, as a table, with place: their number (from 1) inside their group in that order.

    Rows are dealt out by ranges of (group, order) and sorted there; each range numbers its own and the sizes of the ranges before are added, so no task holds
    a group, whatever its size, and the plan above is run once.
    """
    keys = [c.alias(f"__key{k}") for k, c in enumerate(order)]
    names = [group, *(f"__key{k}" for k in range(len(keys)))]
    number = F.monotonically_increasing_id()
    dealt = rows.select("*", *keys).repartitionByRange(*map(F.col, names)).sortWithinPartitions(*names)
    dealt = dealt.select("*", F.shiftright(number, ROW_BITS).alias("__part"), number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("__nth")).drop(*names[1:])
    held = materialize(dealt, what)
    sizes = held.groupBy(group, "__part").agg(F.min("__nth").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(F.col(group), "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return held.join(shift, [group, "__part"]).withColumn("place", (F.col("__nth") + F.col("__shift") + 1).cast("int")).drop("__part", "__nth", "__shift")
