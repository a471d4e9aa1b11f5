"""A scan in which a rule that fails on a file loses that file's rows of that rule and nothing else.

Rules are column expressions, so one that raises ends the job. The whole scan is tried first, and costs nothing more where it succeeds. Where it fails, the rules are halved, then
the files of a rule that still fails, by bits of their hash, until one rule and one file are left: that pair is an error row. Every half that succeeds is a table
that stays, so a failing pair costs some log(rules) scans that stop early and twice one rule's scan over the files.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.plans import scan
from lintlake.schema import CANDIDATE
from lintlake.tables import materialize

ERROR = "path string, rule string, error string"
#: Pairs of a rule and a file that may fail before the scan is given up: so many have one cause, which isn't a rule.
MOST = 200


@dataclass
class Guarded:
    """candidates as of scan.scan_frame(), and errors: path, rule, error."""

    candidates: DataFrame
    errors: DataFrame


def _told(e: Exception) -> str:
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    return next((x for x in lines if not x.startswith(("Job aborted", "Driver stacktrace", "org.apache", "at "))), lines[0] if lines else type(e).__name__)[:300]


def guarded(files: DataFrame, rules: Iterable[str] | None = None, extra: Iterable[scan.Rule] = (), most: int = MOST) -> Guarded:
    """The candidates of built-in and declarative rules over files, and what failed. Files that can't be read at all are the caller's error, and so are more than `most` failures."""
    spark, extra = files.sparkSession, {r.name: (k, r) for k, r in enumerate(extra)}
    names = [*(scan.REGISTRY if rules is None else rules), *extra]
    done: list[DataFrame] = []
    errors: list[tuple] = []

    def attempt(part: DataFrame, chosen: list[str]) -> None:
        found = scan.scan_frame(part, [n for n in chosen if n not in extra], [extra[n][1] for n in chosen if n in extra])
        own = [extra[n][0] for n in chosen if n in extra]
        if own:  # a further rule keeps the number that it has among all of them
            number = F.element_at(F.lit([scan.FIRST_EXTRA + k for k in own]), F.greatest(F.col("ordinal") - scan.FIRST_EXTRA + 1, F.lit(1)))
            found = found.withColumn("ordinal", F.when(F.col("ordinal") >= scan.FIRST_EXTRA, number).otherwise(F.col("ordinal")))
        done.append(materialize(found, "guarded"))

    def walk(part: DataFrame, chosen: list[str], bit: int) -> None:
        try:
            attempt(part, chosen)
        except (PySparkException, Py4JJavaError) as e:
            if len(chosen) > 1:
                half = len(chosen) // 2
                walk(part, chosen[:half], bit)
                walk(part, chosen[half:], bit)
                return
            paths = [r["path"] for r in part.select("path").distinct().limit(2).collect()]
            if len(paths) > 1 and bit < 64:
                for side in (0, 1):
                    walk(part.filter(F.shiftrightunsigned(F.xxhash64("path"), bit).bitwiseAND(F.lit(1)) == side), chosen, bit + 1)
                return
            errors.extend((p, chosen[0], _told(e)) for p in paths)
            if len(errors) > most:
                raise

    try:
        attempt(files, names)
    except (PySparkException, Py4JJavaError):
        held = materialize(files, "files")  # fails for itself where the files are at fault
        half = len(names) // 2
        for chosen in filter(None, (names[:half], names[half:])):
            walk(held, chosen, 0)
    rows = done[0] if done else spark.createDataFrame([], f"path string, package string, {CANDIDATE}")
    for d in done[1:]:
        rows = rows.unionByName(d)
    return Guarded(rows, spark.createDataFrame(errors, ERROR))
