"""Lines, suppression, filters, baselines, order, packages, command line, streaming and plugins."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lintlake import cli, plugins, report, tree_queries
from lintlake.functions.lines import split_lines, strip
from lintlake.plans import scan
from lintlake.plans import registry
from lintlake.sources import baselines, sinks, trees
from lintlake.streaming import watch


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_split_lines_and_strip(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\n\n", "a\n\n", "\ufeffa\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(split_lines(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.splitlines() for t in texts]
    lines = [" a ", "\x1ca\x1f", "\u3000a\u00a0", "a b", "\t"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(strip(F.col("t"))).collect()] == [x.strip() for x in lines]


@pytest.mark.parametrize(
    ("comment", "kept"),
    [("# nosec", False), ("# NOSEC", False), ("# nosec CWE-502, CWE-94", False), ("# nosec cwe-94", True), ("# nosec -- reason", True), ("# nosec trusted", True), ("# nosec: x", False), ("# nosec ,", False), ("# nosecure", True), ("", True)],
)
def test_nosec(spark, comment, kept):
    rows = scan.marked(scan.scan_frame(frame(spark, ("a.py", f"pickle.loads(x)  {comment}")), ["pickle"]))
    assert (rows.first()["fate"] == "kept") == kept


def test_order_of_filters_and_counts(spark):
    text = "pwd = 'abcde1'\napp.run(debug=True)\nassert x in owner  # nosec\n"
    scanned = scan.scan(frame(spark, ("tests/a.py", text), ("b/c.py", text)), ["hardcoded_secrets", "debug_mode", "assert_security"], confidence_min="MEDIUM")
    assert {(r["file"], r["cwe_id"]) for r in scanned.findings.collect()} == {("b/c.py", "CWE-798")}
    assert scanned.counts() == {"nosec_suppressed": 2, "test_suppressed": 1, "baseline_suppressed": 0}


@pytest.mark.parametrize(("path", "extra", "test"), [("a/tests/b.py", (), True), ("tests.py", (), False), ("a/test_b.py", (), True), ("a/b_test.py", (), True), ("a/conftest.py", (), True), ("a\\test\\b.py", (), True), ("a/testing/b.py", (), False), ("eval/b.py", ("eval",), True), ("a/test_b.txt", (), False)])
def test_test_paths(spark, path, extra, test):
    assert spark.createDataFrame([(path,)], "p string").select(scan.is_test_path(F.col("p"), extra)).first()[0] == test


def test_baseline_round_trip(spark, tmp_path):
    files = frame(spark, ("a.py", "pickle.loads(x)\npickle.loads(x)\n"))
    target = str(tmp_path / "b.json")
    assert baselines.write_baseline(scan.scan(files, ["pickle"]).findings, target) == 1
    assert json.loads(open(target).read()) == {"fingerprints": [["CWE-502", "a.py", "pickle.loads(x)"]]}
    moved = frame(spark, ("a.py", "\n\npickle.loads(x)\npickle.loads(y)\npickle.loads(x)"))
    scanned = scan.scan(moved, ["pickle"], baseline=baselines.read_baseline(spark, target))
    assert [r["code_snippet"] for r in scanned.findings.collect()] == ["pickle.loads(y)"] and scanned.counts()["baseline_suppressed"] == 2
    empty = tmp_path / "e.json"
    empty.write_text("{}")
    assert baselines.read_baseline(spark, str(empty)).count() == 0


def test_orders_and_reports(spark):
    text = "h = hashlib.md5(x)\nos.system(c)\n"
    scanned = scan.scan(frame(spark, ("a-b/c.py", text), ("a/b.py", text)), ["weak_hash", "command_injection"])
    assert [(r["path"], r["ordinal"]) for r in scan.in_file_order(scanned.findings).collect()] == [("a/b.py", 3), ("a/b.py", 26), ("a-b/c.py", 3), ("a-b/c.py", 26)]
    assert [(r["path"], r["severity"]) for r in scan.in_severity_order(scanned.findings).collect()] == [("a-b/c.py", "CRITICAL"), ("a/b.py", "CRITICAL"), ("a-b/c.py", "MEDIUM"), ("a/b.py", "MEDIUM")]
    out = io.StringIO()
    assert report.as_json(scanned, out) == 4
    doc = json.loads(out.getvalue())
    assert doc["count"] == 4 and doc["findings"][0]["code"] == "os.system(c)" and "suppression_hint" in doc and "nosec_suppressed" not in doc
    out = io.StringIO()
    report.as_text(scanned, out)
    assert "CRITICAL 2, MEDIUM 2" in out.getvalue() and "Weaknesses that the rules cover" in out.getvalue() and scan.RELEVANCE["CWE-78"] in out.getvalue()
    assert all(f["zero_day_relevance"] for f in doc["findings"]) and {c for c, _, _ in scan.coverage()} <= scan.RELEVANCE.keys()
    assert sorted(r for _, _, rules in scan.coverage() for r in rules) == sorted(scan.REGISTRY)
    assert scan.fails(scanned.findings, "HIGH") and not scan.fails(scanned.findings.filter("severity = 'MEDIUM'"), "HIGH")


def test_sinks_keep_order_and_leave_nothing_of_a_failed_job(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("value")).orderBy(F.desc("value"))
    target = tmp_path / "r.json"
    sinks.save(rows, str(target), "json", '{"rows": [', '],\n"count": {count}}')
    doc = json.loads(target.read_text())
    assert [r["value"] for r in doc["rows"]] == [f"n{k:05d}" for k in reversed(range(5000))] and doc["count"] == 5000
    sinks.save(rows.select(F.concat("value", F.lit("\n"))), str(target), "text", "head\n", "{count} rows\n")
    assert target.read_text().split("\n")[:2] == ["head", "n04999"] and target.read_text().endswith("n00000\n5000 rows\n")
    sinks.save(rows.limit(0), str(target), "json", '{"rows": [', "]}")
    assert json.loads(target.read_text()) == {"rows": []}
    bad = rows.withColumn("value", F.when(F.col("value") == "n00007", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    for path in (tmp_path / "new.json", target):
        with pytest.raises(Exception, match="no"):
            sinks.save(bad, str(path), "json")
    assert [p.name for p in tmp_path.iterdir()] == ["r.json"] and json.loads(target.read_text()) == {"rows": []}


def test_unknown_ranks(spark):
    rows = spark.createDataFrame([("X", "Y")], "severity string, confidence string")
    assert not scan.fails(rows, "INFO")
    assert rows.filter(scan.confidence_rank(F.col("confidence")) <= 0).count() == 1


def test_owner_label_and_nearest(spark):
    rows = spark.createDataFrame([("p", "b", 1, False), ("p", "a", 0, True), ("q", "a", 0, True), ("q", "a2", 0, False)], "path string, package string, ordinal int, is_manifest boolean")
    assert {(r[0], r[1]) for r in scan.owners(rows).collect()} == {("p", "a"), ("q", "a2")}
    roots = spark.createDataFrame([("x", "/w/a/b", "/w"), ("y", "/w/c", "/w"), ("z", "/v/c", "/v/c")], "package string, root string, ceiling string")
    manifests = spark.createDataFrame([("/w", "/w/setup.py"), ("/w/a", "/w/a/Pipfile"), ("/w/a", "/w/a/setup.py"), ("/v", "/v/setup.py")], "dir string, path string")
    assert {(r[0], r[1]) for r in scan.nearest_manifests(roots, manifests).collect()} == {("x", "/w/a/Pipfile"), ("x", "/w/a/setup.py"), ("y", "/w/setup.py")}


def tree(tmp_path):
    for name, text in {"pkg_a/__init__.py": "import os\nos.system(c)\n", "pkg_a/.hid/x.py": "eval(x)\n", "pkg_b/nested/_m.py": "pwd = 'abcde1'\n", "pkg_b/tests/t.py": "pwd = 'abcde1'\n", "none/readme.md": "x", ".venv/v.py": "eval(x)\n", "node_modules/n.py": "eval(x)\n", "loose.py": "app.run(debug=True)\n", "pyproject.toml": "[project]\ndependencies = ['flask>=2.0']\n"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "pkg_a/bad.py").write_bytes(b"os.system(\xff)\n")
    return tmp_path


def run(capsys, spark, cwd, *args):
    code = cli.main(list(args), cwd=cwd, spark=spark)
    return code, capsys.readouterr().out


def test_command_line(spark, tmp_path, capsys):
    cwd = tree(tmp_path / "proj")
    code, out = run(capsys, spark, cwd, "--json", "--exclude", ".hid")
    doc = json.loads(out)
    found = {(f["package"], f["file"].removeprefix(str(cwd) + "/"), f["cwe_id"], f["severity"]) for f in doc["findings"]}
    assert code == 1 and doc["test_suppressed"] == 1
    assert found == {("pkg_a", "pkg_a/__init__.py", "CWE-78", "CRITICAL"), ("pkg_b", "pkg_b/nested/_m.py", "CWE-798", "HIGH"), ("proj", "loose.py", "CWE-489", "MEDIUM"), ("proj", "pyproject.toml", "CWE-1104", "LOW")}
    code, out = run(capsys, spark, cwd, "--json", "--packages", "proj", "--confidence-min", "medium")
    assert code == 0 and [f["cwe_id"] for f in json.loads(out)["findings"]] == ["CWE-1104"]
    (cwd / "uv.lock").write_text("")
    code, out = run(capsys, spark, cwd, "--json", "--package", "only=pkg_b", "--include-tests")
    assert {(f["file"].rpartition("/")[2], f["severity"]) for f in json.loads(out)["findings"]} == {("_m.py", "HIGH"), ("t.py", "HIGH"), ("pyproject.toml", "INFO")}
    base = str(tmp_path / "base.json")
    code, out = run(capsys, spark, cwd, "--write-baseline", base, "--quiet")
    assert code == 0 and "Security audit" in out and "Wrote" not in out
    code, out = run(capsys, spark, cwd, "--baseline", base)
    assert code == 0 and "0 findings" in out and "baseline" in out
    assert run(capsys, spark, cwd, "--json", "--packages")[0] == 0
    bare = tmp_path / "bare"
    bare.mkdir()
    with pytest.raises(SystemExit) as e:
        cli.main([], cwd=bare, spark=spark)
    assert e.value.code == 2
    code, out = run(capsys, spark, cwd, "--write-baseline", base, "--exclude", ".hid", "pkg_b", "--test-paths", "x", "y")
    assert code == 0 and "CWE-78" in out and "Wrote" in out and "nested" not in out and "file(s) in 3 package(s)" in out
    for wrong in (["--packages", "nope"], ["--package", "x"], ["--package", "x=/etc"], ["--config", str(tmp_path / "none.toml")]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong, cwd=cwd, spark=spark)
        assert e.value.code == 2


def registered(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ordinal int, name string, root string, deep boolean")


def test_owners_of_listed_files(spark, tmp_path):
    """Manifests of an earlier package come before sources of a later one; a file of two packages belongs to the first and counts twice."""
    for name in ("a/setup.py", "a/m.py", "a/b/n.py", "a/b/Pipfile", "a/b/uv.lock", "c/lintlake/report.py", "a/x.py/y.txt", "a/not__pycache__/z.py", "a/.venv/v.py"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("")
    root = str(tmp_path)
    (tmp_path / "a/loop").symlink_to(tmp_path / "a")
    both = registered(spark, ("inner", f"{root}/a/b", True), ("outer", f"{root}/a", True))
    got = sorted((r["path"].removeprefix(root + "/"), r["package"], r["locked"]) for r in registry.package_files(both, ["/.venv/"]).collect())
    assert got == [("a/b/Pipfile", "inner", True), ("a/b/n.py", "inner", False), ("a/m.py", "outer", False), ("a/setup.py", "outer", False), ("a/x.py", "outer", False)]
    assert registry.read(both).filter("path LIKE '%/x.py'").first()["text"] is None
    flat, own = registered(spark, ("flat", f"{root}/a", False)), registered(spark, ("own", f"{root}/c", True))
    assert {r["path"].rpartition("/")[2] for r in registry.package_files(flat).collect()} == {"m.py", "setup.py", "x.py"} and registry.package_files(own, own=cli.OWN).count() == 0
    assert registry.file_count(both, ["/.venv/"]).first()["n"] == 5
    listed = trees.listing(both.select("root", "deep"), ["/.venv/"])
    assert not listed.filter("path LIKE '%/.venv/%' OR path LIKE '%/loop/%'").count() and listed.filter("name IN ('.venv', 'loop')").count() == 2


def test_secure_and_noise(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "inner").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path / "inner")
    (tmp_path / "in/up").symlink_to("..")
    (tmp_path / "in/one").symlink_to("two")
    (tmp_path / "in/two").symlink_to("one")
    given = ["in", "in/x/y", "inner", "in/link/x", "in/../x", "in/one/x", "in/up/in/z", "in/link/../in", "/etc", "in/./a/../b"]
    rows = registry.secured(spark.createDataFrame(list(enumerate(given)), "place int, given string").withColumn("name", registry.F.lit("n")), str(tmp_path), [str(tmp_path / "in")])
    got = {r["given"]: (r["ok"], r["root"]) for r in rows.collect()}
    real = str(tmp_path.resolve())
    assert got == {"in": (True, f"{real}/in"), "in/x/y": (True, f"{real}/in/x/y"), "inner": (False, f"{real}/inner"), "in/link/x": (False, f"{real}/inner/x"), "in/../x": (False, f"{real}/x"), "in/one/x": (False, None), "in/up/in/z": (True, f"{real}/in/z"), "in/link/../in": (True, f"{real}/in"), "/etc": (False, "/etc"), "in/./a/../b": (True, f"{real}/in/b")}
    names = spark.createDataFrame([(n,) for n in (".git", "build", "x.egg-info", "builds", "src", "__pycache__")], "name string")
    assert [r["n"] for r in names.select(trees.noise(registry.F.col("name")).alias("n")).collect()] == [True, True, True, False, False, True]


def test_config(spark, tmp_path):
    (tmp_path / "a").mkdir()
    at = str(tmp_path.resolve())
    for text, message in (("[packages", "TOML"), ("x = 1", "packages"), ("[packages]\na = '../../..'", "outside")):
        with pytest.raises(registry.UsageError, match=message):
            registry.registry(spark, at, text, at)
    got = registry.registry(spark, at, "[packages]\nb = 'a'\nc = 'x/../a'\n", at, ["d = a/y", "b=z"]).orderBy("place").collect()
    assert [(r["name"], r["root"]) for r in got] == [("b", f"{at}/z"), ("c", f"{at}/a"), ("d", f"{at}/a/y")]
    (tmp_path / "pyproject.toml").write_text("[tool.uv.workspace]\nmembers = []\n")
    (tmp_path / "a/pyproject.toml").write_text("[tool")
    assert registry.workspace_of(spark, f"{at}/a") == at


def test_discovery_stops_at_the_first_source(spark, tmp_path):
    for name in ("a/x/y/z.py", "b/n.txt", "node_modules/m.py", "c/node_modules/k.py", "proj.py"):
        f = tmp_path / "a_folder" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("")
    got = registry.discovered(spark, str(tmp_path / "a_folder")).orderBy("place").collect()
    assert [(r["name"], r["deep"]) for r in got] == [("a", True), ("c", True), ("a_folder", False)]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.py").write_text("import pickle\npickle.loads(x)\n")
    watch.watch(watch.arriving_files(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), ["pickle", "eval_exec"]).awaitTermination(120)
    (src / "b.py").write_text("eval(x)\n")
    watch.watch(watch.arriving_files(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), ["pickle", "eval_exec"]).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["file"].rpartition("/")[2], r["cwe_id"]) for r in rows} == {("a.py", "CWE-502"), ("b.py", "CWE-94")} and len(rows) == 2


def test_plugins(spark):
    def todo(path, lines, tree):
        if path == "bad.py":
            raise RuntimeError("no")
        return [{"cwe_id": "CWE-546", "cwe_name": "Todo", "severity": "LOW", "line": i} for i, x in enumerate(lines, 1) if "TODO" in x]

    good, errors = plugins.run_procedural(frame(spark, ("a.py", "x\n y # TODO\n"), ("bad.py", "TODO"), ("n.py", None)), {"todo": todo})
    assert [(r["path"], r["line"], r["code_snippet"]) for r in good.collect()] == [("a.py", 2, "y # TODO")]
    assert [(r["path"], r["rule"]) for r in errors.collect()] == [("bad.py", "todo")]
    assert plugins.discover() == []


def test_json_report_is_read_back_in_splits(spark, tmp_path):
    """Findings and counters come back as they were written, whatever stands in the snippets and wherever the splits fall; no row holds the document."""
    texts = ["pickle.loads(x)  # é }\\n    {", "pickle.loads('''],''')  #   {\"count\": 1}", "pickle.loads(\"\\\"\")", "pickle.loads(x)  # nosec"]
    scanned = scan.scan(frame(spark, *((f"d{k % 7}/m{k:03d}.py", texts[k % 4] + "\n") for k in range(200))), ["pickle"], keep=True)
    target = str(tmp_path / "r.json")
    report.save_json(scanned, target)
    doc = json.loads(open(target).read())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found, counters = report.load_json(spark, target)
            assert [r.asDict() for r in found.orderBy("place").drop("place").collect()] == doc["findings"]
            assert sorted(r["place"] for r in found.collect()) == list(range(1, doc["count"] + 1))
            assert [(r["count"], r["nosec_suppressed"], r["test_suppressed"], r["suppression_hint"]) for r in counters.collect()] == [(doc["count"], doc["nosec_suppressed"], None, None)]
            assert sinks.pieces(spark, target, "\n    {").selectExpr("max(length(value))").first()[0] < 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    report.save_json(scan.scan(frame(spark, ("a.py", "x = 1\n")), ["pickle"]), target)
    found, counters = report.load_json(spark, target)
    assert found.count() == 0 and [r["count"] for r in counters.collect()] == [0]


def test_baseline_is_read_back_in_splits(spark, tmp_path, monkeypatch):
    """A fingerprint a line: no task holds the document. Other layouts give the same rows."""
    rows = [(f"CWE-{k % 9}", f"d/é{k:03d}.py", 'x = ["a", "b"],  # \\   ]') for k in range(150)] + [("CWE-1", "a.py", ""), ("CWE-1", "b.py", "{")]
    target = tmp_path / "b.json"
    assert baselines.write_baseline(spark.createDataFrame(rows, "cwe_id string, file string, code_snippet string"), str(target)) == len(rows)
    doc, whole = json.loads(target.read_text()), []
    assert sorted(map(tuple, doc["fingerprints"])) == sorted(rows)
    explode = baselines.F.explode
    monkeypatch.setattr(baselines.F, "explode", lambda c: whole.append(c) or explode(c))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert sorted(map(tuple, baselines.read_baseline(spark, str(target)).collect())) == sorted(rows) and not whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    lines = target.read_text().split("\n")
    for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps({"a": [["x", "y", "z"]]} | doc), "\n".join([*lines[:-3], "  ],", '  "other": [', '    ["x", "y", "z"]', *lines[-3:]])):
        target.write_text(text)
        assert sorted(map(tuple, baselines.read_baseline(spark, str(target)).collect())) == sorted(rows)
    assert whole


def test_text_report_keeps_its_order_over_splits(spark, tmp_path):
    target = tmp_path / "r.txt"
    target.write_text("".join(f"{'' if k % 3 else '  '}line {k}\r\n" for k in range(500)), newline="")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        got = sinks.numbered(sinks.pieces(spark, str(target), "\n").filter("value LIKE '  line%'"), "report").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [(r["place"], r["value"]) for r in got] == [(n + 1, f"  line {k}\r") for n, k in enumerate(range(0, 500, 3))]


def test_a_table_of_files_is_listed_like_folders(spark, sf, tmp_path):
    """The registered tree, written to folders and as a table: the same packages, files, counts and texts. Queries write no file for a file."""
    rel = tree_queries.tree_files(spark, sf).filter("rel NOT LIKE '%mod_1%'").cache()
    both = []
    for root, is_table in ((str(tmp_path / "proj"), False), ("/proj", True)):
        files = rel.select(F.concat(F.lit(f"{root}/"), "rel").alias("path"), "text")
        files.count() if is_table else trees.write(files)
        table = files if is_table else None
        packages = registry.in_order(registry.discovered(spark, root, table)).withColumn("root", F.substring("root", len(root) + 1, 999)).collect()
        known = registered(spark, *((r["name"], root + r["root"], r["deep"]) for r in packages), ("inner", f"{root}/pkg0/tests", True))
        read = registry.read(known, trees.DEFAULT_EXCLUDES, ceiling=root, tree=table).withColumn("path", F.substring("path", len(root) + 1, 999))
        listed = trees.listing(spark.createDataFrame([(root, True), (f"{root}/pkg0", False)], "root string, deep boolean"), ["/deep/"], tree=table)
        listed = listed.withColumns({c: F.substring(c, len(root) + 1, 999) for c in ("root", "path")})
        both.append((sorted(map(repr, packages)), sorted(map(repr, read.select("path", "package", "locked", "text").collect())), registry.file_count(known, [".venv"], tree=table).first()["n"], sorted(map(repr, listed.collect()))))
    assert both[0] == both[1] and len(both[0][1]) > 500
    with pytest.MonkeyPatch.context() as m:
        m.setattr(trees, "write", None)
        m.setattr(trees, "_entries", None)
        assert tree_queries.discovered_packages(spark, sf).count() == len(packages)
