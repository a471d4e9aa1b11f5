"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or the context names it.

    Where neither is set, a local master gets a folder of its own beside Spark's warehouse; on a cluster that is an error, since a
    machine's own folder isn't seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.local.dir', '/tmp')}/lintlake-shared")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lintlake-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: str, of: Column | None = None) -> tuple[DataFrame, int]:
    """materialize(df, what) and the number of its rows (for which `of` holds), counted as they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(F.lit(True) if of is None else of).alias("n")), what)
    return out, seen.get.get("n") or 0


def drop_folder(df: DataFrame) -> None:
    """Delete the folder of a table made by materialize(); nothing may read the table any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def string_col(df: DataFrame, name: str):
    """Column name as a string with null read as the empty text."""
    return F.coalesce(F.col(name).cast(T.StringType()), F.lit(""))


ROW_BITS = 33


def ranged(df: DataFrame, coarse: list[Column], order: list[str]) -> DataFrame:
    """df dealt out by ranges of coarse and sorted by order (which coarse begins), with part (the range) and nth (the place in it)."""
    number = F.monotonically_increasing_id()
    return df.repartitionByRange(*coarse).sortWithinPartitions(*order).select("*", F.shiftright(number, ROW_BITS).alias("part"), number.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("nth"))


def placed(df: DataFrame, group: str, order: list[str], keep_part: bool = False) -> DataFrame:
    """df with place: from 0, inside its group, in that order. A group may lie in many ranges, each of which numbers its own rows, so no task holds a group.

    keep_part: the column part, the range of a row, stays."""
    rows = materialize(ranged(df, [F.col(group), *map(F.col, order)], [group, *order]), "ranges")
    size = rows.groupBy(group, "part").agg(F.min("nth").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(size, [group, "part"]).withColumn("place", F.col("nth") + F.col("shift")).drop("nth", "shift", *(() if keep_part else ("part",)))


def carried(rows: DataFrame, group: str, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """rows of placed(keep_part=True) with a column for each name of columns: (source, whether the row itself counts) -> the source's last value that isn't null.

    A range looks through its own rows of the group; what the ranges before it end with is added, so no task holds a group.
    """
    window = Window.partitionBy(group, "part").orderBy("place")
    sources = sorted({s for s, _ in columns.values()})
    ends = rows.groupBy(group, "part").agg(*(F.max(F.when(F.col(s).isNotNull(), F.struct("place", s)))[s].alias(s) for s in sources))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(group, "part", *(F.last(s, ignorenulls=True).over(before).alias(f"__{s}") for s in sources))
    own = {n: F.last(s, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for n, (s, itself) in columns.items()}
    found = rows.select("*", *(c.alias(f"__own_{n}") for n, c in own.items())).join(ends, [group, "part"])
    return found.select(*rows.columns, *(F.coalesce(f"__own_{n}", f"__{s}").alias(n) for n, (s, _) in columns.items()))
