"""Reports of a scan: text for people, JSON for tools. Executors make the text of sorted ranges of findings; the driver puts it together."""

from __future__ import annotations

import json
import os
import shutil
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.plans import scan
from lintlake.schema import CONFIDENCES, SEVERITIES
from lintlake.sources import sinks
from lintlake.tables import mounted, new_folder

COLOURS = {"CRITICAL": "\033[91m", "HIGH": "\033[93m", "MEDIUM": "\033[94m", "LOW": "\033[96m", "INFO": "\033[90m"}
RESET = "\033[0m"
HINT = "A false positive or accepted risk? Put # nosec [CWE-ID] on its line, or keep known findings in a baseline (--write-baseline, then --baseline)."
NOTES = {"baseline_suppressed": "known finding(s) left out by the baseline", "nosec_suppressed": "finding(s) left out by # nosec", "test_suppressed": "finding(s) in test code left out (see --include-tests)"}


def _hinted(dropped: dict[str, int]) -> bool:
    return not dropped["baseline_suppressed"] and not dropped["nosec_suppressed"]


def save_json(scanned: scan.Scanned, path: str) -> None:
    """Write the JSON document, findings in file order; counters of zero are left out."""
    dropped = scanned.counts()
    found = not scanned.findings.isEmpty()
    rest = {"count": "{count}"} | {k: v for k in NOTES if (v := dropped[k])} | ({"suppression_hint": HINT} if found and _hinted(dropped) else {})
    tail = "],\n" + json.dumps(rest, indent=2)[2:].replace('"{count}"', "{count}") + "\n"
    rows = scan.as_findings(scan.in_file_order(scanned.findings)).select("cwe_id", "cwe_name", "severity", "confidence", "package", "file", "line", F.col("code_snippet").alias("code"), "description", "zero_day_relevance")
    sinks.save(rows, path, "json", '{\n  "findings": [', tail)


JSON_FINDING = "cwe_id string, cwe_name string, severity string, confidence string, package string, file string, line int, code string, description string, zero_day_relevance string"
JSON_COUNTERS = "count bigint, nosec_suppressed bigint, test_suppressed bigint, baseline_suppressed bigint, suppression_hint string"


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """place (from 1) and the findings of a document of save_json(), and its counters as one row; null where the document has none.

    The document is cut where a finding begins, on a line of its own (inside a JSON string no line ends), so tasks read splits of it and none the whole.
    """
    pieces = sinks.pieces(spark, path, "\n    {")
    head = F.col("value").startswith("{")
    found, rest = F.substring_index("value", "\n    }", 1), F.when(head, F.substring_index("value", '"findings": [', -1)).otherwise(F.substring_index("value", "\n    }", -1))
    rows = sinks.numbered(pieces.filter(~head).select(F.from_json(F.concat(F.lit("{"), found, F.lit("}")), JSON_FINDING).alias("f"), "block"), "report")
    closing = pieces.select(F.ltrim(F.translate(rest, "\n", " ")).alias("rest")).filter(F.col("rest").startswith("]"))
    counters = closing.select(F.from_json(F.concat(F.lit("{"), F.regexp_replace("rest", r"^\],", "")), JSON_COUNTERS).alias("c")).select("c.*")
    return rows.select("place", "f.*"), counters


def block(coloured: bool = True) -> Column:
    """What the text report says of a finding."""
    colour = F.coalesce(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))[F.col("severity")], F.lit("")) if coloured else F.lit("")
    package = F.when(F.col("package") != "", F.concat(F.lit("  ("), "package", F.lit(")"))).otherwise("")
    head = F.concat(F.lit("  "), colour, F.lit("["), "severity", F.lit("/"), "confidence", F.lit(f"]{RESET if coloured else ''} "), "cwe_id", F.lit(": "), "cwe_name", F.lit("\n"))
    place = F.concat(F.lit("  "), "file", F.lit(":"), F.col("line").cast("string"), package, F.lit("\n"))
    said = F.concat(F.lit("  "), "code_snippet", F.lit("\n  "), "description", F.lit("\n"))
    return F.concat(head, place, said, F.when(F.col("zero_day_relevance") != "", F.concat(F.lit("  "), "zero_day_relevance", F.lit("\n\n"))).otherwise("\n"))


def save_text(scanned: scan.Scanned, path: str) -> None:
    """Write the text report: findings by severity, then counts."""
    dropped = scanned.counts()
    severities = {r["severity"]: r["n"] for r in scan.by_severity(scanned.findings).collect()}
    confidences = {r["confidence"]: r["n"] for r in scan.by_confidence(scanned.findings).collect()}
    n = sum(severities.values())
    rule = "  " + "=" * 72
    notes = [f"  ({dropped[k]} {what})" for k, what in NOTES.items() if dropped[k]]
    head = ["", rule, f"  Security audit: {n} finding(s)" if n else "  Security audit: all checks passed, 0 findings", *notes, rule, "", ""]
    tail = []
    if n:
        tail = ["  " + ", ".join(f"{k} {severities[k]}" for k in SEVERITIES if k in severities), "  confidence: " + ", ".join(f"{k} {confidences[k]}" for k in CONFIDENCES if k in confidences)]
        tail += [f"  {HINT}"] if _hinted(dropped) else []
        tail += ["", "  Weaknesses that the rules cover", *(f"  {cwe:<9} {title:<48} {', '.join(rules)}" for cwe, title, rules in scan.coverage()), ""]
    rows = scan.as_findings(scan.in_severity_order(scanned.findings)).select(block().alias("value"))
    sinks.save(rows, path, "text", "\n".join(head), "\n".join(tail))


def show(scanned: scan.Scanned, save, out=None) -> None:
    """A report on the terminal: written as a file in the shared folder, then copied in pieces."""
    path = mounted(new_folder(scanned.findings.sparkSession, "report"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    save(scanned, path)
    with open(path, encoding="utf-8", newline="") as f:
        shutil.copyfileobj(f, out or sys.stdout, 1 << 16)
    os.remove(path)


def as_json(scanned: scan.Scanned, out=None) -> int:
    """The JSON document on the terminal; returns the number of findings."""
    show(scanned, save_json, out)
    return scanned.findings.count()


def as_text(scanned: scan.Scanned, out=None) -> int:
    """The text report on the terminal; returns the number of findings."""
    show(scanned, save_text, out)
    return scanned.findings.count()
