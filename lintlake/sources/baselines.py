"""Baselines: the fingerprints of known findings as a JSON document."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.plans.scan import fingerprints
from lintlake.sources import sinks
from lintlake.tables import materialize

#: The lines of a document of write_baseline() that aren't fingerprints: the first two and the last two.
HEAD, TAIL = ["{", '"fingerprints": ['], ["]", "}"]


def _one_a_line(batches):
    """cwe_id, file, code_snippet of each line that is a fingerprint, and the other lines as rest."""
    for b in batches:
        out = []
        for line in b.column(0).to_pylist():
            said = line.strip()
            try:
                one = json.loads(said.removesuffix(","))
            except ValueError:
                one = None
            good = isinstance(one, list) and len(one) >= 3 and all(isinstance(x, str) for x in one[:3])
            out.append((*one[:3], None) if good else (None, None, None, said))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["cwe_id", "file", "code_snippet", "rest"])


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """cwe_id, file, code_snippet; a document without fingerprints gives none.

    A document laid out as write_baseline() does, a fingerprint on each line, is read in splits. One of another layout is parsed as a whole, by one task.
    """
    lines = sinks.pieces(spark, path, "\n").select("value")
    if sorted(r["value"].strip() for r in lines.limit(2).collect()) == sorted(HEAD):
        rows = materialize(lines.mapInArrow(_one_a_line, "cwe_id string, file string, code_snippet string, rest string"), "baseline")
        if sorted(r["rest"] for r in rows.filter("rest IS NOT NULL").limit(5).collect()) == sorted(HEAD + TAIL):  # in JSON these can only stand around the fingerprints
            return rows.filter("rest IS NULL").drop("rest")
    rows = spark.read.schema("fingerprints array<array<string>>").json(path, multiLine=True).select(F.explode("fingerprints").alias("f"))
    return rows.select(F.col("f")[0].alias("cwe_id"), F.col("f")[1].alias("file"), F.col("f")[2].alias("code_snippet"))


def write_baseline(findings: DataFrame, path: str) -> int:
    """Write the distinct fingerprints in order, each range of them by an executor; returns their number."""
    rows = fingerprints(findings).distinct()
    sinks.save(rows.orderBy("cwe_id", "file", "code_snippet"), path, "baseline", '{\n  "fingerprints": [', "]\n}\n")
    return rows.count()
