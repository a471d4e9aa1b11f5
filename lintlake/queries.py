"""Registered queries of the scanner over the synthetic corpus, with their SQL twins.

A text rule's SQL is the same condition run by DuckDB over its own split of the files. DuckDB can't parse Python: a tree rule's SQL joins
the corpus to the rows written down by hand beside each snippet.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake import corpus, plugins, report, tree_queries
from lintlake.functions.lines import split_lines
from lintlake.functions.predicates import any_of
from lintlake.operators import manifest_rules
from lintlake.operators.text_rules import NOT_A_SECRET, TEXT_RULES
from lintlake.operators.tree_rules import TREE_RULES, decode_chains
from lintlake.plans import isolation, scan
from lintlake.schema import severity_rank
from lintlake.sources import baselines, sinks
from lintlake.streaming import versions
from lintlake.tables import mounted, new_folder

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = tuple(r for r in TEXT_RULES if not r.needs_tree and r.name not in ("pth_startup_hooks", "trojan_source"))
GOLDEN = {r.name: (r.ordinal, r.confidence) for r in (*TEXT_RULES, *TREE_RULES) if r not in PLAIN} | {"dependency_cve": (37, "HIGH"), "unbounded_pins": (50, "MEDIUM")}
FOUND = ("path", "package", "line", "text", "code_snippet", "ordinal", "slot", "nth", "cwe_id", "confidence", "severity")


def _rule(name: str) -> Query:
    return lambda spark, sf_dir: scan.scan_frame(corpus.files(spark, sf_dir), [name]).select("path", "line", "cwe_id", "severity", "confidence", "code_snippet")


def _rule_sql(rule, *columns: str) -> str:
    """All cases of a text rule as one SELECT over lines for each slot."""
    parts = []
    for k, slot in enumerate(rule.slots):
        cases = " ".join(f"WHEN {c.when.sql('code')} THEN '{c.severity}'" for c in slot)
        where = "" if rule.comments else "WHERE NOT starts_with(code, '#')"
        parts.append(f"SELECT path, package, number AS line, line AS text, code AS code_snippet, {rule.ordinal} AS ordinal, {k} AS slot, number * 8 + {k} AS nth, '{rule.cwe_id}' AS cwe_id, '{rule.confidence}' AS confidence, CASE {cases} END AS severity FROM lines {where}")
    return f"SELECT {', '.join(columns)} FROM ({' UNION ALL '.join(parts)}) WHERE severity IS NOT NULL"


def _golden_sql(rules, *columns: str) -> str:
    """The rows written down beside the snippets, with the lines that they point at."""
    known = ", ".join(f"('{n}', {GOLDEN[n][0]}, '{GOLDEN[n][1]}')" for n in rules)
    return f"""SELECT {', '.join(columns)} FROM (
  SELECT l.path, l.package, l.number AS line, l.line AS text, coalesce(e.snippet, l.code) AS code_snippet, g.ordinal, e.place AS slot, e.place AS nth, e.cwe_id, g.confidence, e.severity
  FROM expected e JOIN (VALUES {known}) g(rule, ordinal, confidence) ON e.rule = g.rule JOIN lines l ON l.snippet_id = e.snippet_id AND l.number = e.line)"""


def _found_sql() -> str:
    """WITH clauses up to `found`: the candidates of all rules."""
    parts = [_rule_sql(r, *FOUND) for r in PLAIN] + [_golden_sql(GOLDEN, *FOUND)]
    return f"WITH {corpus.files_sql()}, {corpus.expected_sql()}, found AS MATERIALIZED ({' UNION ALL '.join(f'({x})' for x in parts)})"


NOSEC_SQL = r"""(regexp_matches(text, '#\s*nosec\b', 'i') AND (
  len(list_filter(string_split(upper(regexp_extract(text, '#\s*nosec\b(?:\s+([\w,-]+))?', 1, 'i')), ','), lambda x: x <> '')) = 0
  OR list_contains(string_split(upper(regexp_extract(text, '#\s*nosec\b(?:\s+([\w,-]+))?', 1, 'i')), ','), cwe_id)))"""
TEST_SQL = r"regexp_matches(path, '(^|/)(tests|test)/|(^|/)conftest\.py$|(^|/)test_[^/]*\.py$|_test\.py$')"
RANK_SQL = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 99 END"
LEFT_SQL = "path, line, cwe_id, severity, confidence, code_snippet"


def _candidates(spark, sf_dir) -> DataFrame:
    return scan.scan_frame(corpus.files(spark, sf_dir))


def _fated(spark, sf_dir, fate: str) -> DataFrame:
    return scan.marked(_candidates(spark, sf_dir), "MEDIUM").filter(F.col("fate") == fate).select(*LEFT_SQL.split(", "))


FATE_SQL = f"CASE WHEN {NOSEC_SQL} THEN 'nosec' WHEN confidence = 'LOW' THEN 'confidence' WHEN cwe_id IN ('CWE-798', 'CWE-617', 'CWE-918', 'CWE-770') AND {TEST_SQL} THEN 'test' ELSE 'kept' END"


def nosec_suppress(spark, sf_dir):
    return _fated(spark, sf_dir, "nosec")


def confidence_filter(spark, sf_dir):
    return _fated(spark, sf_dir, "confidence")


def test_path_filter(spark, sf_dir):
    return _fated(spark, sf_dir, "test")


def kept_findings(spark, sf_dir):
    return _fated(spark, sf_dir, "kept")


def baseline_distinct(spark, sf_dir):
    return scan.fingerprints(scan.scan(corpus.files(spark, sf_dir)).findings).distinct()


def _baseline(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = scan.scan(corpus.files(spark, sf_dir), keep=True).findings
    return found, scan.fingerprints(found.filter("package IN ('pkg0', 'pkg3')"))


def baseline_anti(spark, sf_dir):
    found, old = _baseline(spark, sf_dir)
    return scan.without_baseline(found, old).select(*LEFT_SQL.split(", "))


def baseline_count(spark, sf_dir):
    found, old = _baseline(spark, sf_dir)
    return found.join(old.distinct(), ["cwe_id", "file", "code_snippet"], "left_semi").agg(F.count("*").alias("baseline_suppressed"))


def report_sort_rank(spark, sf_dir):
    """Place of each finding inside its package's report: severity, path, line, rule, place in the file."""
    rows = _candidates(spark, sf_dir).withColumn("file", F.col("path"))
    return scan.report_places(rows, "package").select("package", "path", "line", "cwe_id", "place")


def report_place(spark, sf_dir):
    """The same over the whole report."""
    rows = scan.scan(corpus.files(spark, sf_dir)).findings
    return scan.report_places(rows).select("package", "path", "line", "cwe_id", "place")


def json_order_rank(spark, sf_dir):
    """Place of each finding inside its package in the order of the JSON report: path components, rule, place in the file."""
    return scan.json_places(_candidates(spark, sf_dir), "package").select("package", "path", "line", "cwe_id", "place")


def display_path(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("path", scan.shown_path(F.col("path"), "pkg1/tests").alias("shown"))


def total_count(spark, sf_dir):
    return scan.scan(corpus.files(spark, sf_dir)).findings.agg(F.count("*").alias("n"))


def severity_rollup(spark, sf_dir):
    return scan.by_severity(_candidates(spark, sf_dir))


def confidence_rollup(spark, sf_dir):
    return scan.by_confidence(_candidates(spark, sf_dir))


def flagship(spark, sf_dir):
    """A full scan's findings by package and severity."""
    found = scan.scan(corpus.files(spark, sf_dir)).findings
    return found.groupBy("package", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def exit_gate(spark, sf_dir):
    """For each threshold whether the scan fails."""
    counts = scan.by_severity(_candidates(spark, sf_dir)).withColumn("rank", severity_rank(F.col("severity")))
    thresholds = spark.createDataFrame([("CRITICAL", 0), ("HIGH", 1), ("MEDIUM", 2), ("LOW", 3), ("INFO", 4)], "fail_on string, least int")
    return thresholds.join(counts, F.col("rank") <= F.col("least"), "left").groupBy("fail_on").agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("fails"))


def _listing(spark, sf_dir) -> DataFrame:
    """Every file twice, once for its own package and once for a package of all; manifests marked."""
    files = corpus.files(spark, sf_dir).select("path", "package")
    manifest = F.element_at(F.split("path", "/"), -1).isin(*manifest_rules.MANIFESTS)
    own = files.select("path", "package", (F.substring("package", 4, 1).cast("int") * 2).alias("ordinal"), manifest.alias("is_manifest"))
    return own.unionByName(files.select("path", F.lit("all").alias("package"), F.lit(3).alias("ordinal"), manifest.alias("is_manifest")))


def package_dedupe(spark, sf_dir):
    return scan.owners(_listing(spark, sf_dir))


def _manifests(spark, sf_dir) -> DataFrame:
    files = corpus.files(spark, sf_dir).filter(F.element_at(F.split("path", "/"), -1).isin(*manifest_rules.MANIFESTS))
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "path")


def manifest_nearest_ancestor(spark, sf_dir):
    """From two folders below each manifest; every second folder has a nearer manifest too, and every third search may not leave its own folder."""
    held = _manifests(spark, sf_dir).withColumn("k", F.regexp_extract("dir", r"(\d+)$", 1).cast("long"))
    nearer = held.filter("k % 2 = 0").select(F.concat("dir", F.lit("/a")).alias("dir"), F.concat("dir", F.lit("/a/setup.py")).alias("path"))
    root = F.concat("dir", F.lit("/a/b"))
    roots = held.select(root.alias("package"), root.alias("root"), F.when(F.col("k") % 3 == 0, root).when(F.col("k") % 3 == 1, F.col("dir")).alias("ceiling"))
    return scan.nearest_manifests(roots, held.select("dir", "path").unionByName(nearer))


def manifest_label(spark, sf_dir):
    manifests = _manifests(spark, sf_dir)
    roots = manifests.filter("path LIKE '%requirements.txt'").select(F.col("dir").alias("root"), F.concat(F.lit("named "), "dir").alias("package"), F.lit(0).alias("ordinal"))
    return scan.manifest_labels(manifests, roots)


def lockfile_severity(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    beside = files.filter("locked").select(F.concat(F.regexp_extract("path", "^(.*/)[^/]*$", 1), F.lit("Pipfile.lock")).alias("path"))
    listing = files.select("path").unionByName(beside)
    return scan.scan_frame(scan.with_locks(files.drop("locked"), listing), ["unbounded_pins"]).select("path", "line", "severity")


def cve_theta_join(spark, sf_dir):
    """Lines of manifests that name a package of the advisory table at an older version, by a join on a pattern."""
    table = spark.createDataFrame([(n, list(v), a) for n, v, a in manifest_rules.VULNERABLE], "name string, sound array<long>, advisory string")
    lines = _lines(spark, sf_dir).filter(F.element_at(F.split("path", "/"), -1).isin(*manifest_rules.MANIFESTS))
    lines = lines.withColumn("version", F.transform(manifest_rules.version(F.col("line")), lambda x: x.cast("long")))
    pattern = F.concat(F.lit(r"(?U)(?:^|[\"'=,\s])"), "name", F.lit(r"(?=[\"':,<>=!\s]|$)"))
    return lines.join(F.broadcast(table), F.rlike(F.lower("line"), pattern) & (F.col("version") < F.col("sound"))).select("path", "number", "name", "advisory")  # ten rows


def _lines(spark, sf_dir) -> DataFrame:
    files = corpus.files(spark, sf_dir).select("path", "snippet_id", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    return files.select("path", "snippet_id", (F.col("at") + 1).alias("number"), "line")


def version_compare(spark, sf_dir):
    found = _lines(spark, sf_dir).withColumn("version", manifest_rules.version(F.col("line"))).filter("version IS NOT NULL")
    return found.select("path", "number", F.array_join("version", ".").alias("version"), manifest_rules.older(F.col("line"), (2, 31, 5)).alias("older"))


def secret_false_positive(spark, sf_dir):
    rows = _lines(spark, sf_dir).filter(any_of("pwd", "password", "token", "connection_url", "secret", lower=True).column(F.col("line")))
    return rows.select("path", "number", NOT_A_SECRET.column(F.col("line")).alias("harmless"))


def decode_chain_fold(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return files.select("path", F.inline(decode_chains(split_lines(F.col("text"))))).select("path", "decoded", "executed")


def line_numbers(spark, sf_dir):
    return _lines(spark, sf_dir).select("path", "number", "line")


def plugin_rule(spark, sf_dir):
    todo = scan.Rule("todo", "CWE-546", "Suspicious Comment", "INFO", lambda line, code, number, path: code.startswith("#") & (number <= 3))
    return scan.scan_frame(corpus.files(spark, sf_dir), [], [todo]).select("path", "line", "cwe_id", "severity", "code_snippet")


def finding_cube(spark, sf_dir):
    """Counts by package, severity and confidence and all sums over these, in one pass."""
    return scan.by_all(scan.scan(corpus.files(spark, sf_dir)).findings)


def content_scan(spark, sf_dir):
    """All candidates, each distinct text scanned once."""
    return scan.scan_by_content(corpus.files(spark, sf_dir)).select(*LEFT_SQL.split(", "))


def baseline_file(spark, sf_dir):
    """The fingerprints that a baseline file gives back, of all findings."""
    target = f"{mounted(new_folder(spark, 'baseline'))}/baseline.json"
    os.makedirs(os.path.dirname(target))
    baselines.write_baseline(scan.scan(corpus.files(spark, sf_dir), keep=True).findings, target)
    return baselines.read_baseline(spark, f"file://{target}")


def _report(spark, sf_dir, save) -> str:
    target = f"{mounted(new_folder(spark, 'report'))}/report"
    os.makedirs(os.path.dirname(target))
    save(scan.scan(corpus.files(spark, sf_dir), keep=True), target)
    return f"file://{target}"


def json_report(spark, sf_dir):
    """The findings of the JSON document in its order, with the document's counters."""
    rows, counters = report.load_json(spark, _report(spark, sf_dir, report.save_json))
    counters = counters.select("count", "nosec_suppressed", "test_suppressed", F.col("suppression_hint").isNotNull().alias("hinted"))
    return rows.select("place", "package", "file", "line", "cwe_id", "severity", "code").crossJoin(counters)  # of one row


def text_report(spark, sf_dir):
    """Places of the text report's findings, in its order, and its closing counts."""
    lines = sinks.pieces(spark, _report(spark, sf_dir, report.save_text), "\n")
    told = lines.filter(F.col("value").rlike(r"^  \S+:\d+  \(pkg\d\)$|^  (?:CRITICAL|confidence:) |^  Security audit"))
    return sinks.numbered(told, "report").select("place", F.col("value").alias("line"))


def _early_comment(path, lines, tree):
    """plugin_rule as a procedural rule; it can't take files of one name."""
    if path.endswith("/setup.cfg"):
        raise ValueError("not a source")
    return [{"line": n, "cwe_id": "CWE-546", "severity": "INFO"} for n, line in enumerate(lines, 1) if n <= 3 and line.strip().startswith("#")]


def table_function_rule(spark, sf_dir):
    """A procedural rule as a table function in SQL; files on which it raises give a row with the error."""
    plugins.register_rule(spark, "early_comment", _early_comment)
    corpus.files(spark, sf_dir).createOrReplaceTempView("lintlake_files")
    return spark.sql("SELECT f.path, r.line, r.cwe_id, r.severity, r.code_snippet, r.error FROM lintlake_files f, LATERAL early_comment(f.path, f.text) r")


LOADS = plugins.FactRule("loads", ("call",), "CWE-502", "Deserialization of Untrusted Data", "HIGH", lambda facts: facts.filter("last = 'loads'"))
#: Lines of calls of that name, written down by hand for the snippets that hold a given text.
LOADED = {"state = pickle.loads(blob)": (2, 3), "w = marshal.loads(b)": (4,), "return cloudpickle.loads(b)  # arrow": (3,), "z = pickle.loads(b)  # nosec cwe-94": (1, 2, 3, 4)}


def fact_rule(spark, sf_dir):
    """A third party's rule over the table of syntax facts."""
    return plugins.run_fact_rules(corpus.files(spark, sf_dir), [LOADS]).select("path", "line", "cwe_id", "severity", "code_snippet")


#: Handlers, and how many of them catch everything, written down by hand for the modules that hold a given text and parse.
HANDLERS = {"except:\n    log(1)": (2, 2), "except Exception as e:\n    print(e)": (2, 2), "except (A, B):": (2, 0)}


def fact_table(spark, sf_dir):
    """How many exception handlers each package has, and how many of them catch everything, from the facts of that kind only."""
    return plugins.facts_table(corpus.files(spark, sf_dir), ["handler"]).groupBy("package").agg(F.count("*").alias("n"), F.count_if("broad").alias("n_broad"))


FRAGILE = scan.Rule("fragile", "CWE-546", "Suspicious Comment", "INFO", lambda line, code, number, path: F.when(path.rlike(r"/mod_1\.py$") & F.raise_error(F.lit("fragile")).isNull(), False).otherwise(code.startswith("#") & (number <= 3)))


def _isolated(spark, sf_dir):
    return isolation.guarded(corpus.files(spark, sf_dir), ["pickle", "weak_hash"], [FRAGILE])


def isolated_scan(spark, sf_dir):
    """Two built-in rules and one that fails on one file: all rows but those of that rule in that file."""
    return _isolated(spark, sf_dir).candidates.select("path", "line", "cwe_id", "severity", "code_snippet")


def isolated_errors(spark, sf_dir):
    return _isolated(spark, sf_dir).errors.select("path", "rule")


def _version(spark, sf_dir, version: int) -> DataFrame:
    """path, version, text of the corpus: in each version every third file holds the next snippet, if both are modules."""
    now = corpus.snippets(spark).select(F.col("snippet_id").alias("next_id"), F.col("text").alias("next"), (F.col("label") == "").alias("next_plain"))
    plain = corpus.snippets(spark).select("snippet_id", (F.col("label") == "").alias("plain"))
    rows = corpus.files(spark, sf_dir).withColumn("next_id", (F.col("snippet_id") + version) % len(corpus.SNIPPETS)).join(F.broadcast(now), "next_id").join(F.broadcast(plain), "snippet_id")  # a fixed number of snippets
    k = F.regexp_extract("path", r"(?:mod_|/d)(\d+)", 1).cast("long")
    return rows.select("path", F.lit(version).cast("long").alias("version"), F.when((k % 3 == 0) & F.col("plain") & F.col("next_plain"), F.col("next")).otherwise(F.col("text")).alias("text"))


def version_changes(spark, sf_dir):
    """Three versions of the corpus as a stream that is stopped after each: what every version brings, ends and leaves as it was."""
    at = new_folder(spark, "versions")
    for version in range(3):
        _version(spark, sf_dir, version).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("path string, version long, text string").parquet(f"{at}/in")
        versions.follow(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(versions.CHANGE).parquet(f"{at}/out").drop("batch")


def documents_tokens(spark, sf_dir):
    """The candidate of the token rules over the prose table: lines that assign a long quoted value to a token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    return docs.filter(F.col("line").rlike(r"(?i)token\s*=\s*[\"'][0-9a-f]{40}[\"']")).groupBy("doc_id").agg(F.count("*").alias("n"))


OPERATORS: tuple[Query, ...] = (
    nosec_suppress, confidence_filter, test_path_filter, kept_findings, baseline_distinct, baseline_anti, baseline_count, report_sort_rank, json_order_rank, display_path, total_count, severity_rollup, confidence_rollup,
    exit_gate, table_function_rule, fact_rule, fact_table, isolated_scan, isolated_errors, version_changes, finding_cube, content_scan, baseline_file, json_report, text_report, report_place, package_dedupe, manifest_nearest_ancestor, manifest_label, lockfile_severity, cve_theta_join, version_compare, secret_false_positive, decode_chain_fold, line_numbers, plugin_rule, documents_tokens,
)


def queries() -> dict[str, Query]:
    out = {f"rule_{n}": _rule(n) for n in (*(r.name for r in PLAIN), *GOLDEN)}
    return out | {f.__name__: f for f in OPERATORS} | {"scan_rollup": flagship} | tree_queries.queries()


def oracle_sql() -> dict[str, str]:
    base = f"WITH {corpus.files_sql()} "
    found = _found_sql()
    marked = f"{found}, marked AS (SELECT *, {FATE_SQL} AS fate FROM found)"
    scanned = f"{found}, scanned AS (SELECT *, path AS file FROM found WHERE NOT {NOSEC_SQL} AND NOT (cwe_id IN ('CWE-798', 'CWE-617', 'CWE-918', 'CWE-770') AND {TEST_SQL})), old AS (SELECT DISTINCT cwe_id, file, code_snippet FROM scanned WHERE package IN ('pkg0', 'pkg3'))"
    held = "EXISTS (SELECT 1 FROM old o WHERE o.cwe_id = s.cwe_id AND o.file = s.file AND o.code_snippet = s.code_snippet)"
    manifests = "regexp_matches(path, '/(pyproject\\.toml|requirements\\.txt|setup\\.py|Pipfile)$')"
    version = r"regexp_extract(line, '(?:>=|==|~=|!=|<|>)\s*(\d+\.\d+\.\d+)', 1)"
    parts = f"list_transform(string_split({version}, '.'), lambda x: CAST(x AS BIGINT))"
    advisories = ", ".join(f"('{n}', {list(v)}, '{a}')" for n, v, a in manifest_rules.VULNERABLE)
    decode, run = r"(base64\.(b64decode|urlsafe_b64decode|decodestring)|zlib\.decompress|bz2\.decompress|codecs\.decode)\s*\(", r"(exec|eval)\s*\("
    lines = "(SELECT path, number, line FROM lines WHERE NOT (line = '' AND number = (SELECT max(l2.number) FROM lines l2 WHERE l2.path = lines.path)))"
    out = {f"rule_{r.name}": f"WITH {corpus.files_sql()} {_rule_sql(r, 'path', 'line', 'cwe_id', 'severity', 'confidence', 'code_snippet')}" for r in PLAIN}
    out |= {f"rule_{n}": f"WITH {corpus.files_sql()}, {corpus.expected_sql()} {_golden_sql([n], 'path', 'line', 'cwe_id', 'severity', 'confidence', 'code_snippet')}" for n in GOLDEN}
    fates = {"nosec_suppress": "nosec", "confidence_filter": "confidence", "test_path_filter": "test", "kept_findings": "kept"}
    out |= {k: f"{marked} SELECT {LEFT_SQL} FROM marked WHERE fate = '{v}'" for k, v in fates.items()}
    return out | {
        "baseline_distinct": f"{scanned} SELECT DISTINCT cwe_id, file, code_snippet FROM scanned",
        "baseline_anti": f"{scanned} SELECT {LEFT_SQL} FROM scanned s WHERE NOT {held}",
        "baseline_count": f"{scanned} SELECT count(*) AS baseline_suppressed FROM scanned s WHERE {held}",
        "report_sort_rank": f"{found} SELECT package, path, line, cwe_id, CAST(row_number() OVER (PARTITION BY package ORDER BY {RANK_SQL}, path COLLATE C, line, ordinal, slot) AS INTEGER) AS place FROM found",
        **tree_queries.oracle_sql(),
        "report_place": f"{scanned} SELECT package, path, line, cwe_id, CAST(row_number() OVER (ORDER BY {RANK_SQL}, path COLLATE C, line, string_split(path, '/'), ordinal, nth) AS INTEGER) AS place FROM scanned",
        "finding_cube": f"{scanned} SELECT package, severity, confidence, CAST(grouping_id(package, severity, confidence) AS INTEGER) AS level, count(*) AS n FROM scanned GROUP BY CUBE (package, severity, confidence)",
        "table_function_rule": f"{base} SELECT path, number AS line, 'CWE-546' AS cwe_id, 'INFO' AS severity, code AS code_snippet, NULL AS error FROM lines WHERE starts_with(code, '#') AND number <= 3 AND path NOT LIKE '%/setup.cfg' UNION ALL SELECT path, NULL, NULL, NULL, NULL, 'ValueError(''not a source'')' FROM files WHERE path LIKE '%/setup.cfg'",
        "fact_rule": f"{base} SELECT path, number AS line, 'CWE-502' AS cwe_id, 'HIGH' AS severity, code AS code_snippet FROM lines JOIN (VALUES {', '.join(f'({k}, {n})' for k, s in enumerate(corpus.SNIPPETS) for text, found_at in LOADED.items() if text in s.text for n in found_at)}) t(snippet_id, line) ON t.snippet_id = lines.snippet_id AND t.line = number",
        "fact_table": f"{base} SELECT package, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_broad) AS BIGINT) AS n_broad FROM files JOIN (VALUES {', '.join(f'({k}, {n}, {broad})' for k, s in enumerate(corpus.SNIPPETS) for text, (n, broad) in HANDLERS.items() if text in s.text and not s.label)}) t(snippet_id, n, n_broad) USING (snippet_id) GROUP BY package",
        "isolated_scan": f"{base} SELECT * FROM ({' UNION ALL '.join(_rule_sql(r, 'path', 'line', 'cwe_id', 'severity', 'code_snippet') for r in PLAIN if r.name in ('pickle', 'weak_hash'))}) UNION ALL SELECT path, number, 'CWE-546', 'INFO', code FROM lines WHERE starts_with(code, '#') AND number <= 3 AND NOT regexp_matches(path, '/mod_1[.]py$')",
        "isolated_errors": f"{base} SELECT path, 'fragile' AS rule FROM files WHERE regexp_matches(path, '/mod_1[.]py$')",
        "version_changes": f"""{found}, marks AS (
  SELECT DISTINCT snippet_id, cwe_id, code_snippet FROM found JOIN files USING (path)
), versions AS (
  SELECT path, v AS version, CASE WHEN k % 3 = 0 AND a.label = '' AND b.label = '' THEN b.snippet_id ELSE a.snippet_id END AS snippet_id
  FROM (SELECT *, CAST(regexp_extract(path, '(?:mod_|/d)([0-9]+)', 1) AS BIGINT) AS k FROM files) f, range(0, 3) t(v), snippets a, snippets b
  WHERE a.snippet_id = f.snippet_id AND b.snippet_id = (f.snippet_id + v) % {len(corpus.SNIPPETS)}
), held AS (
  SELECT path, version, cwe_id, code_snippet FROM versions JOIN marks USING (snippet_id)
)
SELECT path, version, cwe_id, code_snippet, CASE WHEN old THEN CASE WHEN now THEN 'unchanged' ELSE 'gone' END ELSE 'new' END AS change FROM (
  SELECT path, version, cwe_id, code_snippet, bool_or(now) AS now, bool_or(old) AS old FROM (
    SELECT *, TRUE AS now, FALSE AS old FROM held UNION ALL SELECT path, version + 1, cwe_id, code_snippet, FALSE, TRUE FROM held WHERE version < 2
  ) GROUP BY path, version, cwe_id, code_snippet)""",
        "content_scan": f"{found} SELECT {LEFT_SQL} FROM found",
        "baseline_file": f"{scanned} SELECT DISTINCT cwe_id, file, code_snippet FROM scanned",
        "json_report": f"""{scanned}, dropped AS (SELECT count(*) FILTER (WHERE {NOSEC_SQL}) AS nosec_suppressed, count(*) FILTER (WHERE NOT {NOSEC_SQL} AND cwe_id IN ('CWE-798', 'CWE-617', 'CWE-918', 'CWE-770') AND {TEST_SQL}) AS test_suppressed FROM found)
SELECT CAST(row_number() OVER (ORDER BY string_split(path, '/'), ordinal, nth) AS INTEGER) AS place, package, file, line, cwe_id, severity, code_snippet AS code, count(*) OVER () AS count, nosec_suppressed, test_suppressed, FALSE AS hinted FROM scanned, dropped""",
        "text_report": f"""{scanned}, told AS (
  SELECT 0 AS part, 0 AS k, '  Security audit: ' || count(*) || ' finding(s)' AS line FROM scanned
  UNION ALL SELECT 1, row_number() OVER (ORDER BY {RANK_SQL}, path COLLATE C, line, string_split(path, '/'), ordinal, nth), '  ' || file || ':' || line || '  (' || package || ')' FROM scanned
  UNION ALL SELECT 2, 0, '  ' || string_agg(severity || ' ' || n, ', ' ORDER BY {RANK_SQL}) FROM (SELECT severity, count(*) AS n FROM scanned GROUP BY severity)
  UNION ALL SELECT 3, 0, '  confidence: ' || string_agg(confidence || ' ' || n, ', ' ORDER BY confidence = 'LOW', confidence) FROM (SELECT confidence, count(*) AS n FROM scanned GROUP BY confidence)
) SELECT CAST(row_number() OVER (ORDER BY part, k) AS INTEGER) AS place, line FROM told""",
        "json_order_rank": f"{found} SELECT package, path, line, cwe_id, CAST(row_number() OVER (PARTITION BY package ORDER BY string_split(path, '/'), ordinal, nth) AS INTEGER) AS place FROM found",
        "display_path": f"{base} SELECT path, CASE WHEN starts_with(path, 'pkg1/tests/') THEN substr(path, 12) ELSE path END AS shown FROM files",
        "total_count": f"{scanned} SELECT count(*) AS n FROM scanned",
        "scan_rollup": f"{scanned} SELECT package, severity, count(*) AS n, count(DISTINCT path) AS n_files FROM scanned GROUP BY package, severity",
        "severity_rollup": f"{found} SELECT severity, count(*) AS n FROM found GROUP BY severity",
        "confidence_rollup": f"{found} SELECT confidence, count(*) AS n FROM found GROUP BY confidence",
        "exit_gate": f"{found} SELECT fail_on, EXISTS (SELECT 1 FROM found WHERE {RANK_SQL} <= least) AS fails FROM (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3), ('INFO', 4)) t(fail_on, least)",
        "package_dedupe": f"{base} SELECT path, CASE WHEN package IN ('pkg0', 'pkg1') THEN package ELSE 'all' END AS package FROM files",
        "manifest_nearest_ancestor": f"{base} SELECT dir || '/a/b' AS package, CASE WHEN k % 2 = 0 THEN dir || '/a/setup.py' ELSE path END AS path FROM (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CAST(regexp_extract(path, '(\\d+)/[^/]*$', 1) AS BIGINT) AS k FROM files WHERE {manifests}) WHERE k % 3 <> 0",
        "manifest_label": f"{base} SELECT path, CASE WHEN path LIKE '%requirements.txt' THEN 'named ' || regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE regexp_extract(path, '([^/]*)/[^/]*$', 1) END AS label FROM files WHERE {manifests}",
        "lockfile_severity": f"WITH {corpus.files_sql()}, {corpus.expected_sql()} SELECT path, CAST(line AS INTEGER) AS line, severity FROM files JOIN expected USING (snippet_id) WHERE rule = 'unbounded_pins'",
        "cve_theta_join": f"{base} SELECT path, number, name, advisory FROM lines JOIN (VALUES {advisories}) t(name, sound, advisory) ON regexp_matches(lower(line), '(?:^|[\"''=,\\s])' || name || '(?:[\"'':,<>=!\\s]|$)') WHERE {manifests} AND {version} <> '' AND {parts} < CAST(sound AS BIGINT[])",
        "version_compare": f"{base} SELECT path, number, {version} AS version, {parts} < CAST([2, 31, 5] AS BIGINT[]) AS older FROM lines WHERE {version} <> ''",
        "secret_false_positive": f"{base} SELECT path, number, {NOT_A_SECRET.sql('line')} AS harmless FROM lines WHERE {any_of('pwd', 'password', 'token', 'connection_url', 'secret', lower=True).sql('line')}",
        "decode_chain_fold": f"""WITH RECURSIVE {corpus.files_sql()}, told AS (
  SELECT path, number, regexp_matches(line, '{decode}') AS decodes, regexp_matches(line, '{run}') AS runs, row_number() OVER (PARTITION BY path ORDER BY number) AS k
  FROM lines WHERE NOT starts_with(code, '#') AND (regexp_matches(line, '{decode}') OR regexp_matches(line, '{run}'))
), fold AS (
  SELECT path, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS open, CAST(NULL AS INTEGER) AS decoded, CAST(NULL AS INTEGER) AS executed FROM (SELECT DISTINCT path FROM told)
  UNION ALL
  SELECT path, k, CASE WHEN hit THEN list_slice(opened, 1, len(opened) - 1) ELSE opened END, CASE WHEN hit THEN opened[len(opened)] END, CASE WHEN hit THEN number END FROM (
    SELECT path, k, number, opened, runs AND len(opened) > 0 AND coalesce(number - opened[len(opened)], 99) <= 5 AS hit FROM (
      SELECT t.path, t.k, t.number, t.runs, CASE WHEN t.decodes THEN list_append(f.open, t.number) ELSE f.open END AS opened FROM fold f JOIN told t ON t.path = f.path AND t.k = f.k + 1))
) SELECT path, decoded, executed FROM fold WHERE executed IS NOT NULL""",
        "line_numbers": f"{base} SELECT path, number, line FROM {lines}",
        "plugin_rule": f"{base} SELECT path, number AS line, 'CWE-546' AS cwe_id, 'INFO' AS severity, code AS code_snippet FROM lines WHERE starts_with(code, '#') AND number <= 3",
        "documents_tokens": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, 'token\\s*=\\s*[\"''][0-9a-f]{40}[\"'']', 'i') GROUP BY doc_id",
    }
