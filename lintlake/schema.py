"""The finding record, and the orders of severities and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks; an unknown severity ranks last and never gates, an unknown confidence ranks first.
SEVERITIES = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}
CONFIDENCES = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}

FINDING = "cwe_id string, cwe_name string, severity string, confidence string, package string, file string, line int, code_snippet string, description string, zero_day_relevance string"
COLUMNS = [x.split()[0] for x in FINDING.split(", ")]
#: A candidate of one file before it gets its package; `text` is the whole source line, for suppression comments.
CANDIDATE = "ordinal int, seq int, cwe_id string, cwe_name string, severity string, confidence string, line int, code_snippet string, description string, text string"


def rank(column: Column, order: dict[str, int], unknown: int) -> Column:
    pairs = [F.lit(x) for kv in order.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(unknown))


def severity_rank(column: Column) -> Column:
    return rank(column, SEVERITIES, 99)


def confidence_rank(column: Column) -> Column:
    return rank(column, CONFIDENCES, 0)
