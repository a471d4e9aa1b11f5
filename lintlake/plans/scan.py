"""The scan: files (path, text) to findings, and what follows: suppression, filters, baselines, order and rollups.

Rules need no shuffle. First, literals that a rule can't do without are looked for in the whole text; a file without any goes no further, and the
rest carries a bit for each rule that may apply. What is left of a file becomes rows (its lines, the facts of its syntax tree, and
findings about the whole file) by one generator; a row gives small integers, one for each case of a rule that holds, and these meet the table of
cases in a broadcast join. The syntax-tree UDF gets the text of Python files that may satisfy a rule that needs it, and gathers the facts that the
chosen rules read; it drops out of the plan where no chosen rule needs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.lines import line_at, split_lines, strip
from lintlake.functions.predicates import folded, may_match, spark_text
from lintlake.operators import manifest_rules
from lintlake.operators.facts import FACT_DDL, LINE_SETS, facts_column, literal_column
from lintlake.operators.relevance import RELEVANCE
from lintlake.operators.text_rules import TEXT_RULES
from lintlake.operators.tree_rules import DECODE, EXECUTE, TREE_RULES, decode_chains
from lintlake.schema import CANDIDATE, COLUMNS, SEVERITIES, confidence_rank, severity_rank
from lintlake.tables import materialize, placed

MANIFEST_RULES = {"dependency_cve": 37, "unbounded_pins": 50}
# Registry order, the findings that count less in tests, and their test folders.
REGISTRY = tuple(n for _, n in sorted([*((r.ordinal, r.name) for r in (*TEXT_RULES, *TREE_RULES)), *((v, k) for k, v in MANIFEST_RULES.items())]))
DEPRIORITISED = ("CWE-798", "CWE-617", "CWE-918", "CWE-770")
TEST_DIRS = ("tests", "test")
NOSEC = r"(?iU)#\s*nosec\b(?:\s+([\w,-]+))?"
FIRST_EXTRA = 100
READY = "struct<case: int, seq: int, extra: string, snippet: string>"


@dataclass(frozen=True)
class Rule:
    """A third party's rule: a predicate over the columns line, code (stripped), number and path of each line."""

    name: str
    cwe_id: str
    cwe_name: str
    severity: str
    predicate: Callable[[Column, Column, Column, Column], Column]
    confidence: str = "MEDIUM"
    description: str = ""


class _Cases:
    """The table of cases: a number for each way in which a rule gives a finding."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, ordinal: int, cwe_id: str, cwe_name: str, severity: str, confidence: str, description: str) -> int:
        self.rows.append((len(self.rows), ordinal, cwe_id, cwe_name, severity, confidence, description))
        return len(self.rows) - 1

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "case int, ordinal int, cwe_id string, cwe_name string, severity string, confidence string, told string")


class _Gates:
    """A bit for each rule that may apply to a file, by a test in Spark SQL (None: always)."""

    def __init__(self):
        self.tests: list[str] = []

    def add(self, test: str | None) -> int:
        self.tests.append(test or "true")
        return 1 << (len(self.tests) - 1)

    def column(self) -> Column:
        return F.expr(" | ".join(f"(CASE WHEN {test} THEN {1 << k}L ELSE 0L END)" for k, test in enumerate(self.tests)))


def _open(bits: int) -> str:
    """Whether a file's gate has any of the bits."""
    return f"(gate & {bits}L) <> 0"


def _hit(when: Column, case, seq) -> Column:
    """A finding of a row where the condition holds."""
    return F.when(when, F.struct((case if isinstance(case, Column) else F.lit(case)).alias("case"), seq.cast("int").alias("seq")))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each computed once a row: a generator's output, which the optimiser doesn't put in place of its uses."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _ready(case: Column, seq, number: Column, extra: Column | None = None, snippet: Column | None = None) -> Column:
    """A finding about the whole file, as a row that a later step takes as it is."""
    none = F.lit(None).cast("string")
    found = F.struct(case.alias("case"), (seq if isinstance(seq, Column) else F.lit(seq)).cast("int").alias("seq"), (none if extra is None else extra).alias("extra"), (none if snippet is None else snippet).alias("snippet"))
    return F.struct(number.cast("int").alias("number"), found.alias("ready"))


def scan_frame(files: DataFrame, rules: Iterable[str] | None = None, extra: Iterable[Rule] = ()) -> DataFrame:
    """Candidates with path and package: one row for each finding before any filter.

    files: path and text (null where unreadable); package, and locked (whether a lockfile stands beside a manifest), if there. Rules
    go by registry name; all by default. extra: further rules, after the built-in ones. Only files whose names end in .py have a syntax tree.
    """
    chosen, extra = set(REGISTRY if rules is None else rules), list(extra)
    if unknown := chosen - set(REGISTRY):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    text_rules = [r for r in TEXT_RULES if r.name in chosen]
    tree_rules = [r for r in TREE_RULES if r.name in chosen]
    has, text = set(files.columns), F.col("text")
    base = files.select("path", "text", (F.col("package") if "package" in has else F.lit("")).alias("package"), (F.coalesce("locked", F.lit(False)) if "locked" in has else F.lit(False)).alias("locked"))
    base = _once(base.filter("text IS NOT NULL"), low=folded(text), wide=F.octet_length("text") != F.char_length("text"), name=F.element_at(F.split("path", "/"), -1), is_py=F.col("path").endswith(".py"), is_pth=F.col("path").endswith(".pth"))

    cases, gates, told, by_line, by_fact, whole, asks, lined = _Cases(), _Gates(), [], [], [], [], 0, 0
    code, number, parsed, comment = F.col("code"), F.col("number"), F.col("parsed"), F.col("comment")
    for r in text_rules:
        test = "wide" if r.wide else may_match([c.when for slot in r.slots for c in slot], "text", "low")
        bit = gates.add(f"{test} OR (wide AND is_py)" if r.needs_tree and test else test)
        lined, asks = lined | bit, asks | (bit if r.needs_tree else 0)
        allowed = " AND ".join([_open(bit), *([] if r.comments else ["NOT comment"]), *(["NOT is_pth"] if r.files == "!pth" else [])])
        for k, slot in enumerate(r.slots):
            ways = " ".join(f"WHEN {c.when.expr('code')} THEN named_struct('case', {cases.add(r.ordinal, r.cwe_id, r.cwe_name, c.severity, r.confidence, c.description)}, 'seq', number * 8 + {k})" for c in slot)
            told.append(f"CASE WHEN {allowed} THEN CASE {ways} END END")
    for r in tree_rules:
        bit = gates.add(" OR ".join([*(f"contains(text, {spark_text(n)})" for n in r.needs), "wide"]))
        asks |= bit
        for c in r.cases:
            case = cases.add(r.ordinal, c.cwe_id or r.cwe_id, r.cwe_name, c.severity, r.confidence, c.description)
            by_fact.append(lambda f, c=c, case=case: F.when((f["kind"] == c.kind) & c.when(f), F.struct(F.lit(case).alias("case"), f["seq"].alias("seq"), (F.lit(None).cast("string") if c.extra is None else c.extra(f)).alias("extra"))))
        for c in r.lines:
            lined |= bit
            case = cases.add(r.ordinal, r.cwe_id, r.cwe_name, c.severity, r.confidence, c.description)
            by_line.append(_hit(F.expr(_open(bit)) & ~comment & c.when(code, parsed), case, number + 1_000_000 if c.after else number))
        if r.name == "decode_exec_chains":
            case = F.lit(cases.add(r.ordinal, r.cwe_id, r.cwe_name, "CRITICAL", r.confidence, "Decoded data is executed nearby"))
            chain = lambda x: F.concat(F.lit("decode at line "), x["decoded"].cast("string"), F.lit(", exec at line "), x["executed"].cast("string"))
            whole.append(F.when(F.expr(_open(bit)) & text.rlike(DECODE) & text.rlike(EXECUTE), F.transform(decode_chains(F.col("lines")), lambda x, i: _ready(case, i - 1_000_000, x["executed"], snippet=chain(x)))))
    if "dependency_cve" in chosen:
        bit = gates.add(f"name IN ({', '.join(map(spark_text, manifest_rules.MANIFESTS))})")
        first = F.lit([cases.add(37, "CWE-1104", "Known Vulnerable Dependency", "HIGH", "HIGH", f"{n} before {'.'.join(map(str, v))}: {advisory}") for n, v, advisory in manifest_rules.VULNERABLE][0])
        hits = F.filter(manifest_rules.vulnerable(F.col("lines")), lambda x: x["number"].isNotNull())
        whole.append(F.when(F.expr(_open(bit)), F.transform(hits, lambda x: _ready(first + x["entry"], x["entry"], x["number"]))))
    if "unbounded_pins" in chosen:
        bit = gates.add(f"name IN ({', '.join(map(spark_text, manifest_rules.PINNED))})")
        lined |= bit
        held = cases.add(50, "CWE-1104", "Unbounded Dependency", "INFO", "MEDIUM", "No upper bound; the lockfile holds until the next upgrade")
        free = cases.add(50, "CWE-1104", "Unbounded Dependency", "LOW", "MEDIUM", "No upper bound: a later bad release is taken at once")
        by_line.append(_hit(F.expr(_open(bit)) & manifest_rules.loose(code), F.when(F.col("locked"), held).otherwise(free), number))
    if "pth_startup_hooks" in chosen:
        bit = gates.add("is_pth")
        start_up = F.lit(cases.add(48, "CWE-829", "Code from an Untrusted Sphere", "CRITICAL", "MEDIUM", "A start-up file runs with the interpreter"))
        numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("number"), strip(x).alias("code")))
        runs = F.filter(numbered, lambda x: (x["code"] != "") & ~x["code"].startswith("#"))
        whole.append(F.when(F.expr(_open(bit)), F.transform(F.slice(runs, 1, 1), lambda x: _ready(start_up, 0, x["number"]))))
    if extra:
        lined |= gates.add(None)
    for k, r in enumerate(extra):
        case = cases.add(FIRST_EXTRA + k, r.cwe_id, r.cwe_name, r.severity, r.confidence, r.description)
        by_line.append(_hit(r.predicate(F.col("line"), code, number, F.col("path")), case, number))
    if not cases.rows:
        return files.sparkSession.createDataFrame([], f"path string, package string, {CANDIDATE}")

    base = _once(_once(base, gate=gates.column()).filter("gate <> 0"), lines=split_lines(text))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    if asks:
        kinds = sorted({c.kind for r in tree_rules for c in r.cases})
        base = base.withColumn("facts", facts_column(F.when(F.col("is_py") & F.expr(_open(asks)), text), kinds, any(r.needs_tree for r in text_rules)))
    else:
        base = base.withColumn("facts", F.lit(None).cast("struct<found: array<int>>"))
    facts = F.col("facts")
    needed = {n: f for n, f in ((n, F.coalesce(facts[n], F.array().cast("array<int>"))) for n in LINE_SETS) if any(r.needs_tree for r in text_rules)}
    lxml = facts["lxml"] if needed else F.lit(None).cast("string")

    unit = lambda number, line, fact, ready: F.struct(number.cast("int").alias("number"), line.alias("line"), fact.alias("fact"), ready.alias("ready"))
    no_fact, no_ready = F.lit(None).cast(FACT_DDL), F.lit(None).cast(READY)
    kind = "struct<number: int, line: string, fact: " + FACT_DDL + ", ready: " + READY + ">"
    parts = []
    if lined:
        parts.append(F.when(F.expr(_open(lined)), F.transform("lines", lambda x, i: unit(i + 1, x, no_fact, no_ready))))
    if by_fact:
        parts.append(F.transform(facts["found"], lambda f: unit(f["line"], line_at(F.col("lines"), f["line"]), f, no_ready)))
    parts += [F.transform(w, lambda x: unit(x["number"], line_at(F.col("lines"), x["number"]), no_fact, x["ready"])) for w in whole]
    units = F.concat(*(F.coalesce(p, empty(kind)) for p in parts))
    rows = base.select("path", "package", "gate", "locked", "is_pth", facts.isNotNull().alias("parsed"), lxml.alias("lxml_name"), *(f.alias(f"{n}_lines") for n, f in needed.items()), F.inline(F.array(F.struct(units.alias("units")))))
    rows = _once(rows.select("*", F.inline("units")).drop("units"), code=strip(F.col("line")))
    rows = rows.withColumn("comment", F.col("code").startswith("#"))
    for n in needed:
        rows = rows.withColumn(n, F.array_contains(f"{n}_lines", number))
    if needed:
        quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("lxml_name", r"([.])", r"\\."), F.lit(r"\."))
        rows = rows.withColumn("lxml_use", F.coalesce(F.when(F.col("lxml_name").isNotNull(), F.rlike(code, quoted)), F.lit(False)))
    fact, ready = F.col("fact"), F.col("ready")
    nothing, hit = F.lit(None).cast("string"), "array<struct<case: int, seq: int, extra: string>>"
    by_line = ([F.expr(f"array({', '.join(told)})")] if told else []) + ([F.array(*by_line)] if by_line else [])
    full = lambda x: F.struct(x["case"], x["seq"].cast("int").alias("seq"), nothing.alias("extra"))
    lines_found = F.transform(F.array_compact(F.concat(*by_line) if len(by_line) > 1 else by_line[0]), full).cast(hit) if by_line else F.array().cast(hit)
    facts_found = F.array_compact(F.array(*(f(fact) for f in by_fact))).cast(hit) if by_fact else F.array().cast(hit)
    found = F.when(ready.isNotNull(), F.array(F.struct(ready["case"], ready["seq"], ready["extra"])).cast(hit)).when(fact.isNotNull(), facts_found).otherwise(lines_found)
    rows = _once(rows, found=found)
    rows = rows.select("path", "package", number.alias("line"), F.coalesce(ready["snippet"], code).alias("code_snippet"), F.col("line").alias("text"), F.inline("found"))
    out = rows.join(F.broadcast(cases.frame(files.sparkSession)), "case")  # a fixed number of cases
    description = F.when(F.col("extra").isNotNull(), F.replace("told", F.lit("{}"), F.col("extra"))).otherwise(F.col("told"))
    out = out.withColumn("description", description).select("path", "package", *(x.split()[0] for x in CANDIDATE.split(", ")))
    if "trojan_source" in chosen:
        trojan = F.when(F.col("ordinal") == 38, F.col("code_snippet"))
        out = out.withColumn("code_snippet", F.coalesce(literal_column(trojan), F.col("code_snippet")))
    return out


def coverage() -> list[tuple[str, str, list[str]]]:
    """cwe_id, its name and the rules for it, of the whole registry."""
    named = [(r.ordinal, r.cwe_id, r.cwe_name, r.name) for r in (*TEXT_RULES, *TREE_RULES)]
    named += [(37, "CWE-1104", "", "dependency_cve"), (50, "CWE-1104", "", "unbounded_pins")]
    found: dict[str, tuple[str, list[str]]] = {}
    for _, cwe, title, rule in sorted(named):
        found.setdefault(cwe, (title, []))[1].append(rule)
    return [(cwe, title, rules) for cwe, (title, rules) in sorted(found.items(), key=lambda x: int(x[0][4:]))]


def suppressed(text: Column, cwe_id: Column) -> Column:
    """Whether the line's comment suppresses the finding: alone it does, with ids only for those (any case)."""
    scope = F.filter(F.transform(F.split(F.upper(F.regexp_extract(text, NOSEC, 1)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return text.rlike(NOSEC) & ((F.size(scope) == 0) | F.array_contains(scope, cwe_id))


def is_test_path(path: Column, extra: Iterable[str] = ()) -> Column:
    """Whether a file is test code by its name or the name of a folder above it."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name = F.element_at(parts, -1)
    named = (name == "conftest.py") | (name.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py")))
    return named | F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, (*TEST_DIRS, *extra))))


def shown_path(path: Column, root: str | None = None) -> Column:
    """The path relative to the workspace root, where it lies below it."""
    if not root:
        return path
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


@dataclass
class Scanned:
    """Findings that count, with their order columns, and how many rows each step dropped."""

    findings: DataFrame
    dropped: DataFrame

    def counts(self) -> dict[str, int]:
        row = self.dropped.first()
        return {k: int(row[k] or 0) for k in ("nosec_suppressed", "test_suppressed", "baseline_suppressed")}


def marked(candidates: DataFrame, confidence_min: str = "LOW", include_tests: bool = False, test_dirs: Iterable[str] = (), root: str | None = None) -> DataFrame:
    """Candidates with file and fate: kept, nosec, confidence or test; the first step that drops a row names it."""
    rows = candidates.withColumn("file", shown_path(F.col("path"), root))
    least = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}[confidence_min.upper()]
    test = F.lit(False) if include_tests else F.col("cwe_id").isin(*DEPRIORITISED) & is_test_path(F.col("file"), test_dirs)
    fate = F.when(suppressed(F.col("text"), F.col("cwe_id")), "nosec").when(confidence_rank(F.col("confidence")) > least, "confidence").when(test, "test").otherwise("kept")
    return rows.withColumn("fate", fate)


def fingerprints(findings: DataFrame) -> DataFrame:
    return findings.select("cwe_id", "file", "code_snippet")


def without_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint (cwe_id, file, code_snippet) the baseline doesn't hold; all copies of a held one go."""
    return findings.join(baseline.distinct(), ["cwe_id", "file", "code_snippet"], "left_anti")


def scan(files: DataFrame, rules: Iterable[str] | None = None, extra: Iterable[Rule] = (), baseline: DataFrame | None = None, keep: bool = False, **options) -> Scanned:
    """The whole scan of files; options as in marked(). keep: write the candidates as a table, so that findings, counts and gate don't each scan anew. With a baseline they always are."""
    return judged(scan_frame(files, rules, extra), baseline, keep, **options)


def judged(candidates: DataFrame, baseline: DataFrame | None = None, keep: bool = False, **options) -> Scanned:
    """What follows on the candidates of a scan: suppression, filters and baseline."""
    rows = marked(candidates, **options)
    rows = materialize(rows, "candidates") if keep or baseline is not None else rows
    kept = rows.filter("fate = 'kept'")
    sums = rows.agg(F.count_if(F.col("fate") == "nosec").alias("nosec_suppressed"), F.count_if(F.col("fate") == "test").alias("test_suppressed"))
    if baseline is None:
        return Scanned(kept, sums.withColumn("baseline_suppressed", F.lit(0)))
    known = kept.join(baseline.distinct(), ["cwe_id", "file", "code_snippet"], "left_semi").agg(F.count("*").alias("baseline_suppressed"))
    return Scanned(without_baseline(kept, baseline), sums.crossJoin(known))  # of one row each


def as_findings(rows: DataFrame) -> DataFrame:
    """The ten columns of a finding, in the order of rows."""
    known = F.create_map(*(F.lit(x) for pair in RELEVANCE.items() for x in pair))
    return rows.withColumn("zero_day_relevance", F.coalesce(known[F.col("cwe_id")], F.lit(""))).select(*COLUMNS)


def in_file_order(rows: DataFrame) -> DataFrame:
    """By path components, registry order and place in the file."""
    return rows.orderBy(F.split("path", "/"), "ordinal", "seq")


def in_severity_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(severity_rank(F.col("severity")), "file", "line", F.split("path", "/"), "ordinal", "seq")


def report_places(rows: DataFrame, group: str | None = None) -> DataFrame:
    """rows with place, their number (from 1) in the order of the text report, in all or inside each group; the scan runs once and no task holds a group."""
    return _places(rows, group, [severity_rank(F.col("severity")), F.col("file"), F.col("line"), F.split("path", "/"), F.col("ordinal"), F.col("seq")])


def json_places(rows: DataFrame, group: str | None = None) -> DataFrame:
    """rows with place in the order of the JSON report."""
    return _places(rows, group, [F.split("path", "/"), F.col("ordinal"), F.col("seq")])


def _places(rows: DataFrame, group: str | None, order: list[Column]) -> DataFrame:
    if group is not None:
        return placed(rows, group, order)
    return placed(rows.withColumn("__all", F.lit(0)), "__all", order).drop("__all")


def by_all(rows: DataFrame) -> DataFrame:
    """package, severity, confidence, level, n: counts of findings for every set of these columns in one pass; level has a bit for each column that is summed over (4, 2, 1)."""
    return rows.cube("package", "severity", "confidence").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def by_confidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("confidence").agg(F.count("*").alias("n"))


def fails(rows: DataFrame, fail_on: str = "HIGH") -> bool:
    """Whether any row is at least as severe as fail_on."""
    return not rows.filter(severity_rank(F.col("severity")) <= SEVERITIES[fail_on.upper()]).isEmpty()


def owners(files: DataFrame) -> DataFrame:
    """One row for each path: the first registered package owns it, and in a package sources come before manifests.

    files: path, package, ordinal (of the package), is_manifest.
    """
    return files.groupBy("path").agg(F.min_by("package", F.struct("ordinal", "is_manifest")).alias("package"))


def nearest_manifests(roots: DataFrame, manifests: DataFrame) -> DataFrame:
    """package, path of the manifests in the nearest folder at or above each root that has any.

    roots: package, root, ceiling (null: up to the file system's root). manifests: dir, path.
    """
    parts = F.split("root", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    climbed = roots.select("package", "ceiling", F.inline(above)).filter(F.col("ceiling").isNull() | F.col("dir").startswith(F.col("ceiling")))
    held = manifests.select("dir").distinct()
    nearest = climbed.join(held, "dir", "left_semi").groupBy("package").agg(F.max_by("dir", "depth").alias("dir"))
    return nearest.join(manifests, "dir").select("package", "path")


def manifest_labels(manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """path, label: the first package rooted in the manifest's folder, else the folder's name, else root."""
    first = roots.groupBy(F.col("root").alias("dir")).agg(F.min_by("package", "ordinal").alias("package"))
    name = F.element_at(F.split("dir", "/"), -1)
    return manifests.join(first, "dir", "left").select("path", F.coalesce("package", F.when(name != "", name), F.lit("root")).alias("label"))


def with_locks(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files with locked: a lockfile, or for other manifests a requirements.txt, stands in the same folder. listing: path of all files."""
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    locks = listing.filter(name.isin(*manifest_rules.LOCKFILES)).select(folder.alias("dir")).distinct().withColumn("by_lock", F.lit(True))
    needs = listing.filter(name == "requirements.txt").select(folder.alias("dir")).distinct().withColumn("by_list", F.lit(True))
    rows = files.withColumn("dir", folder).join(locks, "dir", "left").join(needs, "dir", "left")
    locked = F.coalesce("by_lock", F.lit(False)) | (F.coalesce("by_list", F.lit(False)) & (name != "requirements.txt"))
    return rows.withColumn("locked", locked).drop("dir", "by_lock", "by_list")


def scan_by_content(files: DataFrame, rules: Iterable[str] | None = None, salts: int = 32) -> DataFrame:
    """The same rows as scan_frame(), but each distinct text is split, parsed and matched once, and its findings go to all paths that hold it.

    What the built-in rules see of a path (its name, or that it ends in .py or .pth) and locked are part of the key, with a 256-bit digest of the text. Vendored and generated files stand
    at very many paths: these are dealt out by a salt, and the few findings of a text are sent to every salt that it has, so a text of a million paths isn't one task.
    """
    has, name = set(files.columns), F.substring_index("path", "/", -1)
    manifests = {*manifest_rules.MANIFESTS, *manifest_rules.PINNED}
    seen = F.when(name.isin(*manifests), name).when(F.col("path").endswith(".py"), ".py").when(F.col("path").endswith(".pth"), ".pth").otherwise("")
    locked = F.coalesce("locked", F.lit(False)) if "locked" in has else F.lit(False)
    keyed = files.filter("text IS NOT NULL").select("path", (F.col("package") if "package" in has else F.lit("")).alias("package"), F.concat_ws(" ", F.sha2("text", 256), seen, locked.cast("string")).alias("key"), seen.alias("seen"), locked.alias("locked"), "text")
    salt = F.pmod(F.xxhash64("path"), F.lit(salts))
    # the representative's path is its key: it shows a rule the same ending or name
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.first("seen").alias("seen"), F.first("locked").alias("locked"))
    texts = texts.select(F.concat(F.col("key"), F.when(F.col("seen").startswith("."), F.concat(F.lit("/x"), "seen")).otherwise(F.concat(F.lit("/"), "seen"))).alias("path"), "text", F.col("key").alias("package"), "locked")
    found = scan_frame(texts, rules).drop("path").withColumnRenamed("package", "key")
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    columns = ["path", "package", *(x.split()[0] for x in CANDIDATE.split(", "))]
    return keyed.select("path", "package", "key", salt.alias("salt")).join(found, ["key", "salt"]).select(*columns)


__all__ = ["CANDIDATE", "REGISTRY", "Rule", "Scanned", "line_at", "scan", "scan_frame"]
