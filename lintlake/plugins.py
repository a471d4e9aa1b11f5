"""Rules of third parties.

A declarative rule is a scan.Rule, a predicate over the columns of a line. A FactRule is a transform of the table of syntax facts. A procedural one is a Python function (path, lines,
tree) -> findings, run for each file on the executors, for all files at once or as a table function in SQL; when it raises, that file's rows of that rule are lost and an error row says so.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeResult, udtf

from lintlake.functions.lines import line_at, split_lines, strip
from lintlake.operators.facts import FACT, KINDS, facts_column
from lintlake.schema import CANDIDATE
from lintlake.tables import materialize

GROUP = "lintlake.rules"


def discover(warn: Callable[[str], None] = print) -> list:
    """Rules of installed packages; one that can't be loaded is reported and left out."""
    found = []
    for entry in entry_points(group=GROUP):
        try:
            found.append(entry.load())
        except Exception as e:
            warn(f"warning: plugin {entry.name} can't be loaded: {e}")
    return found


def run_procedural(files: DataFrame, rules: dict[str, Callable], first: int = 200) -> tuple[DataFrame, DataFrame]:
    """Candidates of the rules over files (path, text, package), and errors (path, rule, error).

    A finding is a mapping with cwe_id, cwe_name, severity, line, and optionally confidence, code_snippet and description.
    """
    names = list(rules)

    def run(batches):
        for b in batches:
            out = []
            for path, package, lines, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    tree = None
                for k, name in enumerate(names):
                    try:
                        for seq, f in enumerate(rules[name](path, lines, tree)):
                            number = int(f["line"])
                            line = lines[number - 1] if 0 < number <= len(lines) else ""
                            snippet = line.strip() if f.get("code_snippet") is None else f["code_snippet"]
                            out.append((path, package, first + k, seq, f["cwe_id"], f["cwe_name"], f["severity"], f.get("confidence", "MEDIUM"), number, snippet, f.get("description", ""), line, None))
                    except Exception as e:
                        out.append((path, package, first + k, 0, None, None, None, None, None, None, name, None, repr(e)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), *[pa.string()] * 4]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], columns)

    schema = f"path string, package string, {CANDIDATE}, error string"
    columns = [x.split()[0] for x in schema.split(", ")]
    package = F.col("package") if "package" in files.columns else F.lit("")
    rows = files.select("path", package.alias("package"), split_lines(F.col("text")).alias("lines"), "text")
    found = rows.mapInArrow(run, schema).cache()  # findings and errors come from one pass
    good = found.filter("error IS NULL").drop("error")
    return good, found.filter("error IS NOT NULL").select("path", F.col("description").alias("rule"), "error")


def facts_table(files: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """The syntax facts of Python files (path, text, package): one row for each call, handler, def, switched-on allow_pickle and request field, of the kinds asked for.

    path, package, the fields of a fact (kind, seq, line, full, last, kws and so on), text: the source line, code: the same without the blanks around it. Only those kinds are gathered
    while the tree is walked. Files that don't parse, null texts and other files have none.
    """
    kinds = tuple(dict.fromkeys(kinds))
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
    package = F.col("package") if "package" in files.columns else F.lit("")
    python = files.filter(F.col("path").endswith(".py") & F.col("text").isNotNull())
    rows = python.select("path", package.alias("package"), split_lines(F.col("text")).alias("__lines"), facts_column(F.col("text"), kinds, False).alias("__facts"))
    rows = rows.select("path", "package", "__lines", F.inline("__facts.found"))
    text = line_at(F.col("__lines"), F.col("line"))
    return rows.select("path", "package", *FACT, text.alias("text"), strip(text).alias("code"))


@dataclass(frozen=True)
class FactRule:
    """A third party's rule over syntax facts: a transform of the table of facts of its kinds to the rows that are findings; it may join, group and add a column description."""

    name: str
    kinds: tuple[str, ...]
    cwe_id: str
    cwe_name: str
    severity: str
    transform: Callable[[DataFrame], DataFrame]
    confidence: str = "MEDIUM"
    description: str = ""


def run_fact_rules(files: DataFrame, rules: Iterable[FactRule], first: int = 300) -> DataFrame:
    """Candidates of rules over facts. Files are parsed once, for the kinds that the rules ask for; each rule sees its own kinds."""
    rules = list(rules)
    facts = facts_table(files, [k for r in rules for k in r.kinds])
    facts = materialize(facts, "facts") if len(rules) > 1 else facts
    columns = ["path", "package", *(x.split()[0] for x in CANDIDATE.split(", "))]
    out = files.sparkSession.createDataFrame([], f"path string, package string, {CANDIDATE}")
    for k, r in enumerate(rules):
        rows = r.transform(facts.filter(F.col("kind").isin(*r.kinds)))
        told = F.col("description") if "description" in rows.columns else F.lit(r.description)
        fixed = {"ordinal": F.lit(first + k), "cwe_id": F.lit(r.cwe_id), "cwe_name": F.lit(r.cwe_name), "severity": F.lit(r.severity), "confidence": F.lit(r.confidence), "code_snippet": F.col("code"), "description": told}
        out = out.unionByName(rows.select(*((fixed[c] if c in fixed else F.col(c)).alias(c) for c in columns)))
    return out


def register_rule(spark: SparkSession, name: str, rule: Callable) -> None:
    """A procedural rule as a table function for SQL: SELECT f.path, r.* FROM files f, LATERAL name(f.path, f.text) r.

    Its columns are line, cwe_id, severity, code_snippet, what the rule's own `columns` (DDL) names beside them, and error: where the rule raises on a file it gives one row, with
    nothing but the error. Findings are mappings, as for run_procedural().
    """
    own = T.StructType.fromDDL(rule.columns) if getattr(rule, "columns", None) else T.StructType()
    schema = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("cwe_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("code_snippet", T.StringType()), *own.fields, T.StructField("error", T.StringType())])

    class Table:
        @staticmethod
        def analyze(path, text) -> AnalyzeResult:
            for given in (path, text):
                if not isinstance(given.dataType, T.StringType):
                    raise ValueError("a rule's table function takes the path and the text of a file, both strings")
            return AnalyzeResult(schema)

        def eval(self, path: str, text: str):
            try:
                lines = (text or "").splitlines()
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    tree = None
                found = []
                for f in rule(path, lines, tree):
                    number = int(f["line"])
                    line = lines[number - 1].strip() if 0 < number <= len(lines) else ""
                    found.append((number, f["cwe_id"], f["severity"], f.get("code_snippet", line), *(f.get(x.name) for x in own.fields), None))
            except Exception as e:
                yield (None,) * (len(schema) - 1) + (repr(e),)
                return
            yield from found

    spark.udtf.register(name, udtf(Table))
