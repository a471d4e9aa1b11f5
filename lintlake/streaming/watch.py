"""Findings of files as they arrive: rules see one file at a time, so a scan of a stream is the same projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.lines import decoded
from lintlake.plans import scan


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, text of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), decoded(F.col("content")).alias("text"))


def watch(files: DataFrame, sink: str, checkpoint: str, rules=None, extra=(), once: bool = True):
    """Append every file's kept findings to a Parquet table; with once, take what is there and stop."""
    rows = scan.marked(scan.scan_frame(files, rules, extra)).filter("fate = 'kept'")
    writer = scan.as_findings(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(sink)
