"""Reports and baselines as data sources to write to: executors turn sorted rows into parts of the file, and the driver puts the parts together at commit. What was written is read back in splits.

    rows.write.format("lintlake").option("path", "report.json").option("form", "json").option("counts", "{}").mode("overwrite").save()

Parts are written beside the target under names of their own and copied, as bytes, in the order of the partitions, so no row passes through the driver and its memory doesn't grow
with the report. The target appears by one rename: a failed job leaves nothing, neither a file nor parts. All machines must see the target's folder.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass
from json.encoder import encode_basestring_ascii as quoted

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lintlake.tables import materialize, mounted

#: What stands between a row and the next, for each form.
BETWEEN = {"json": ",", "baseline": ",", "text": ""}


def _said(column: list, indent: str) -> list[str]:
    """JSON of a column's values; most are strings, which the encoder takes one by one without looking at their kind."""
    return [quoted(v) if isinstance(v, str) else json.dumps(v, indent=2).replace("\n", indent) for v in column]


def _encoded(form: str, batch) -> list[str]:
    """What the file has of each row of a record batch."""
    columns = [c.to_pylist() for c in batch.columns]
    if form == "text":
        return columns[0]
    if form == "baseline":
        return [f"\n    [{', '.join(row)}]" for row in zip(*(_said(c, " ") for c in columns), strict=True)]
    named = [[f"\n      {quoted(n)}: {v}" for v in _said(c, "\n      ")] for n, c in zip(batch.schema.names, columns, strict=True)]
    return [f"\n    {{{','.join(row)}\n    }}" for row in zip(*named, strict=True)]


@dataclass
class Part(WriterCommitMessage):
    """Where a partition's part stands, and how many rows it has."""

    partition: int
    path: str
    rows: int


def _given_up(parts: str) -> None:
    """Delete the folder of the parts: first it gets another name, under which no task adds to it."""
    gone = f"{parts}.gone"
    try:
        os.rename(parts, gone)
    except FileNotFoundError:
        return
    shutil.rmtree(gone, ignore_errors=True)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.form, self.head, self.tail = options.get("form", "json"), options.get("head", ""), options.get("tail", "")
        self.target = mounted(options["path"])
        if self.form not in BETWEEN:
            raise ValueError(f"unknown form: {self.form}")
        if os.path.exists(self.target) and not overwrite:
            raise ValueError(f"{self.target} exists; write with mode('overwrite')")
        self.parts = options.get("parts") or f"{self.target}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)  # by the driver, once: a task that is still at work when the job is given up can't bring it back

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        path, n = f"{self.parts}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with open(path, "w", encoding="utf-8", newline="") as out:
            for batch in iterator:
                if batch.num_rows:
                    out.write((BETWEEN[self.form] if n else "") + BETWEEN[self.form].join(_encoded(self.form, batch)))
                    n += batch.num_rows
        return Part(task.partitionId(), path, n)

    def commit(self, messages):
        made = f"{self.target}.{uuid.uuid4().hex}"
        total = sum(m.rows for m in messages if m)
        try:
            with open(made, "wb") as out:
                out.write(self.head.encode("utf-8"))
                first = True
                for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                    out.write(b"" if first else BETWEEN[self.form].encode("utf-8"))
                    first = False
                    with open(m.path, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                    os.remove(m.path)  # so the rows stand once on the disk, and not twice
                out.write((("\n  " if total and self.form != "text" else "") + self.tail.replace("{count}", str(total))).encode("utf-8"))
            os.replace(made, self.target)
        finally:
            if os.path.exists(made):
                os.remove(made)
            _given_up(self.parts)

    def abort(self, messages):
        _given_up(self.parts)


class Sink(DataSource):
    """Options: path, form (json, baseline or text), head and tail of the file; {count} in the tail is the number of rows."""

    @classmethod
    def name(cls):
        return "lintlake"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def save(rows: DataFrame, path: str, form: str, head: str = "", tail: str = "") -> None:
    """Write rows, which are sorted by range, to a file of that form."""
    rows.sparkSession.dataSource.register(Sink)
    parts = f"{mounted(path)}.parts-{uuid.uuid4().hex}"
    try:
        rows.write.format("lintlake").option("path", path).option("form", form).option("head", head).option("tail", tail).option("parts", parts).mode("overwrite").save()
    finally:
        _given_up(parts)  # a query that fails before its rows are written isn't aborted


def pieces(spark: SparkSession, path: str, between: str) -> DataFrame:
    """value, block: the pieces of a file between signs, read in splits (block is where a piece's split begins), so no task holds the file."""
    return spark.read.option("lineSep", between).text(path).select("value", F.col("_metadata.file_block_start").alias("block"))


def numbered(rows: DataFrame, what: str) -> DataFrame:
    """rows of pieces(), filtered or not, as a table with place: their number (from 1) in the order of the file. Each split numbers its own, and the sizes of the splits before are added."""
    held = materialize(rows.withColumn("__nth", F.monotonically_increasing_id()), what)
    sizes = held.groupBy("block").agg(F.min("__nth").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("block", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    return held.join(F.broadcast(shift), "block").withColumn("place", (F.col("__nth") + F.col("__shift")).cast("int")).drop("block", "__nth", "__shift")  # a row for each split
