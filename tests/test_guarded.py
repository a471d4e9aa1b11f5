"""Isolation of failing rules, rules over facts, table functions, file versions and scans by content."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from lintlake import plugins
from lintlake.operators.tree_rules import TREE_RULES
from lintlake.plans import isolation, scan
from lintlake.streaming import versions

FILES = [(f"p/m{k}.py", "p", f"import pickle\npickle.loads(b)\n# note\nh = hashlib.md5(x)\neval(y{k})\n") for k in range(40)]


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, package string, text string").repartition(4)


def test_a_failing_built_in_rule_loses_its_own_rows(spark, files, monkeypatch):
    """One built-in rule is made to fail on two files: its rows there are lost, and nothing else."""
    broken = next(r for r in TREE_RULES if r.name == "eval_exec")
    case = broken.cases[0]
    raises = dataclasses.replace(case, when=lambda f: F.when(F.col("path").isin("p/m7.py", "p/m33.py") & F.raise_error(F.lit("broken rule")).isNull(), False).otherwise(case.when(f)))
    changed = dataclasses.replace(broken, cases=(raises, *broken.cases[1:]))
    names = ["pickle", "weak_hash", "eval_exec"]
    whole = rows(scan.scan_frame(files, names), "path", "line", "cwe_id", "ordinal")
    monkeypatch.setattr(scan, "TREE_RULES", tuple(changed if r is broken else r for r in TREE_RULES))
    got = isolation.guarded(files, names)
    assert rows(got.candidates, "path", "line", "cwe_id", "ordinal") == [r for r in whole if not (r[0] in ("p/m7.py", "p/m33.py") and r[3] == broken.ordinal)]
    errors = got.errors.collect()
    assert sorted((e["path"], e["rule"]) for e in errors) == [("p/m33.py", "eval_exec"), ("p/m7.py", "eval_exec")] and all("broken rule" in e["error"] for e in errors)


def test_nothing_fails(files):
    got = isolation.guarded(files, ["pickle"])
    assert got.candidates.count() == 40 and got.errors.count() == 0


def test_further_rules_keep_their_numbers(spark, files):
    mark = lambda name, code: scan.Rule(name, "CWE-1", "x", "LOW", lambda line, c, n, path: c == code)
    bad = scan.Rule("bad", "CWE-2", "y", "LOW", lambda line, c, n, path: F.when((path == "p/m3.py") & F.raise_error(F.lit("no")).isNull(), True).otherwise(n == 1))
    got = isolation.guarded(files, [], [mark("a", "# note"), bad, mark("b", "import pickle")])
    assert {r["ordinal"]: r["n"] for r in got.candidates.groupBy("ordinal").agg(F.count("*").alias("n")).collect()} == {100: 40, 101: 39, 102: 40}


def test_what_is_no_rules_fault_is_raised(spark, files):
    unreadable = files.withColumn("text", F.when(F.col("path") == "p/m1.py", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        isolation.guarded(unreadable, ["pickle"])
    every = scan.Rule("every", "CWE-2", "y", "LOW", lambda line, c, n, path: F.raise_error(F.lit("always")).isNull())
    with pytest.raises(Exception, match="always"):
        isolation.guarded(files, [], [every], most=2)


def test_facts_as_a_table(spark):
    text = "import a\ntry:\n    a.b.c(1, k=True)\nexcept Exception:\n    pass\n\ndef f():\n    return g()\n"
    frame = spark.createDataFrame([("x.py", text), ("y.txt", text), ("z.py", "def ("), ("n.py", None)], "path string, text string")
    assert rows(plugins.facts_table(frame, ["call"]), "path", "line", "full", "code") == [("x.py", 3, "a.b.c", "a.b.c(1, k=True)"), ("x.py", 8, "g", "return g()")]
    assert rows(plugins.facts_table(frame), "kind", "line") == [("call", 3), ("call", 8), ("def", 7), ("handler", 4)]
    with pytest.raises(ValueError, match="unknown"):
        plugins.facts_table(frame, ["loop"])


def test_rules_over_facts_join_and_group(spark, files):
    twice = plugins.FactRule("many", ("call",), "CWE-3", "z", "LOW", lambda t: t.join(t.groupBy("path").agg(F.count("*").alias("n")).filter("n >= 3").select("path"), "path").filter("seq = 3 OR last = 'eval'").withColumn("description", F.concat(F.lit("seen "), "full")))
    named = plugins.FactRule("named", ("def",), "CWE-4", "z", "LOW", lambda t: t)
    found = plugins.run_fact_rules(files, [twice, named])
    assert {(r["ordinal"], r["description"]) for r in found.collect()} == {(300, "seen eval")} and found.count() == 40
    assert scan.marked(found).filter("fate = 'kept'").count() == 40


def test_table_functions_take_two_strings_and_have_their_own_columns(spark):
    def longest(path, lines, tree):
        return [{"line": lines.index(max(lines, key=len)) + 1, "cwe_id": "CWE-9", "severity": "INFO", "size": max(map(len, lines))}]

    longest.columns = "size int"
    plugins.register_rule(spark, "longest_line", longest)
    spark.createDataFrame([("a.py", "x\nlong\n"), ("b.py", ""), ("c.py", None)], "path string, text string").createOrReplaceTempView("longest_files")
    got = spark.sql("SELECT f.path, r.* FROM longest_files f, LATERAL longest_line(f.path, f.text) r").collect()
    assert sorted((r["path"], r["line"], r["size"], r["code_snippet"], bool(r["error"])) for r in got if r["path"] == "a.py") == [("a.py", 2, 4, "long", False)]
    assert all(r["error"] and r["line"] is None for r in got if r["path"] != "a.py") and len(got) == 3
    with pytest.raises(Exception, match="both strings"):
        spark.sql("SELECT * FROM longest_line(1, 'x')").collect()


def test_versions_survive_restarts_and_repeats(spark, tmp_path):
    at, schema = str(tmp_path), "path string, version long, text string"

    def put(*batch):
        spark.createDataFrame(list(batch), schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        versions.follow(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint", ["pickle", "weak_hash"]).awaitTermination()
        return rows(spark.read.schema(versions.CHANGE).parquet(f"{at}/out"), "path", "version", "cwe_id", "change")

    first = put(("a.py", 1, "pickle.loads(x)\npickle.loads(x)\n"), ("b.py", 1, ""), ("a.py", 2, "pickle.loads(x)\nh = hashlib.md5(x)\n"))
    assert sorted((path, version, change) for path, version, _, change in first) == [("a.py", 1, "new"), ("a.py", 2, "new"), ("a.py", 2, "unchanged")]
    assert put(("a.py", 1, "eval(x)\n"), ("a.py", 2, "pickle.loads(y)\n")) == first  # seen already
    last = put(("a.py", 3, None), ("b.py", 2, "pickle.loads(z)\n"))
    assert sorted(r[3] for r in last if r not in first) == ["gone", "gone", "new"]


def test_texts_are_scanned_once_each(spark):
    text = "import pickle\npickle.loads(b)\nx = ['dask==2020.1.1']\n"
    frame = spark.createDataFrame([(f"d{k}/m.py", "p", text, False) for k in range(300)] + [("setup.py", "p", text, True), ("d/setup.py", "q", text, False), ("d/x.txt", "q", text, False), ("n.py", "q", None, False)], "path string, package string, text string, locked boolean")
    columns = ("path", "package", "line", "ordinal", "seq", "cwe_id", "code_snippet", "text")
    assert rows(scan.scan_by_content(frame), *columns) == rows(scan.scan_frame(frame), *columns)
    parsed = spark.sparkContext.accumulator(0)
    seen = scan.facts_column

    def counting(texts, *options):
        def note(t):
            parsed.add(t is not None)
            return t

        return seen(F.udf(note, "string")(texts), *options)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(scan, "facts_column", counting)
        found = scan.scan_by_content(frame, ["eval_exec", "pickle"])
        found.write.format("noop").mode("overwrite").save()
    assert parsed.value <= 3  # as a module, as two manifests, as text


def test_versions_are_compared_without_a_python_call_for_each_file(spark, tmp_path):
    """State is a table that is joined; many versions in a batch, repeats of one version, a batch that is done again, and a file that comes back to nothing."""
    schema = "path string, version long, text string"
    put = lambda *batch: spark.createDataFrame(list(batch), schema)
    held = spark.createDataFrame([], versions.HELD)
    bad, worse = "pickle.loads(x)\n", "h = hashlib.md5(x)\n"
    linked = versions.linked(held, put(("a", 5, worse), ("a", 2, bad), ("a", 2, worse), ("a", 9, ""), ("b.py", 1, None)), ["pickle", "weak_hash"])
    got = rows(versions.changes(linked), "path", "version", "cwe_id", "change")
    assert got == [("a", 2, "CWE-328", "new"), ("a", 2, "CWE-502", "new"), ("a", 5, "CWE-328", "unchanged"), ("a", 5, "CWE-502", "gone"), ("a", 9, "CWE-328", "gone")]
    plan = versions.changes(linked)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan
    held = linked.filter("next IS NULL").select(*versions.MARK)
    assert rows(held, *versions.MARK) == [("a", 9, None, None), ("b.py", 1, None, None)]
    later = versions.linked(held, put(("a", 9, bad), ("b.py", 3, bad)), ["pickle"])
    assert rows(versions.changes(later), "path", "version", "cwe_id", "change") == [("b.py", 3, "CWE-502", "new")]
    assert rows(later.filter("next IS NULL"), "path", "version") == [("a", 9), ("b.py", 3)]
