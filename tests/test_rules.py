"""Rules over small sources: (cwe_id, severity, confidence, line) as a sorted bag, all rules together where the name is None."""

import re
import time

import pytest

from lintlake import corpus
from lintlake.operators.facts import facts
from lintlake.operators.text_rules import TEXT_RULES
from lintlake.operators.tree_rules import TREE_RULES
from lintlake.plans import scan

CASES = [
    # every rule is seen by its own source; what must not be found stands beside it
    ("joblib_twice", None, "m.py", "x = joblib.load('m.pkl')\n", [("pickle", 1), ("model_file_load", 1)]),
    ("driver_twice", None, "m.py", "b.exec_driver_sql(f'drop {t}')\n", [("sql_injection", 1), ("exec_driver_sql", 1)]),
    ("numpy_twice", None, "m.py", "np.load(f, allow_pickle=True)\n", [("insecure_default", 1), ("numpy_load", 1)]),
    ("inline_decode_twice", ["decode_exec_chains"], "m.py", "exec(zlib.decompress(x))\n", [("decode_exec_chains", 1)] * 2),
    ("spaced_equality", ["assert_security"], "m.py", "assert user.role == 'admin'\n", []),
    ("comment", ["pickle", "trojan_source"], "m.py", "# pickle.loads(x)\n# a\u202eb\n", [("trojan_source", 2)]),
    ("docstring", ["pickle", "eval_exec"], "m.py", '"""pickle.loads(x) eval(y)"""\n', [("pickle", 1)]),
    ("chained_receiver", ["sql_injection"], "m.py", "T = 'a'\n(db\n .execute(f'x {T}'))\n", [("sql_injection", 3)]),
    ("lambda_never_safe", ["ssrf"], "m.py", "f = lambda: requests.get('http://a')\n", [("ssrf", 1)]),
    ("class_body_never_safe", ["ssrf"], "m.py", "class A:\n    r = requests.get('http://a')\n", [("ssrf", 2)]),
    ("request_method_literal", ["ssrf", "request_timeout"], "m.py", "requests.request('GET', u)\n", [("request_timeout", 1)]),
    ("loop_target", ["ssrf"], "m.py", "for u in us:\n    requests.get(u)\n", [("ssrf", 2)]),
    ("keyword_pack", ["request_timeout"], "m.py", "requests.get(u, **kw)\n", [("request_timeout", 1)]),
    ("form_feed", ["except_pass"], "m.py", "x = 1\x0c\ntry:\n    a()\nexcept A:\n    pass\n", [("except_pass", 4)]),
    ("pth_name", ["pth_startup_hooks"], "a/x.pth", "\n# c\n  import os\nimport sys\n", [("pth_startup_hooks", 3)]),
    ("cve_not_prefixed", ["dependency_cve"], "requirements.txt", "acme-dask==2020.1.1\ndask==2020.1\ndask!=2020.1.1\n", [("dependency_cve", 3)]),
    ("cve_other_file", ["dependency_cve"], "a.txt", "dask==2020.1.1\n", []),
    ("cve_version_of_another", ["dependency_cve"], "setup.py", "x = ['flask==1.0.0', 'dask']\n", [("dependency_cve", 1)]),
    ("pins_setup", ["unbounded_pins"], "setup.py", "x = ['flask>=1.0']\n", []),
    ("pins", ["unbounded_pins"], "pyproject.toml", "'a[b]>=1.0'\n'flask>=1.0'\n'flask>=1.0,<2'\nflask>=1.0\n", [("unbounded_pins", 2)]),
    ("pydantic_typing", ["unbounded_pydantic_field"], "m.py", "class AInput(pydantic.BaseModel):\n    a: typing.Optional[str]\n    b: 'str'\n    c: str | int\n    d: constr(max_length=3)\n", [("unbounded_pydantic_field", 4)]),
    ("random_parts", ["insecure_random"], "m.py", "random.SystemRandom().choice(x)\nrandom.choice(x)\n", [("insecure_random", 2)]),
    ("warnings", ["insufficient_logging"], "m.py", "try:\n    a()\nexcept Exception:\n    warnings.warn('x')\ntry:\n    a()\nexcept Exception:\n    catalog(1)\n", [("insufficient_logging", 7)]),
]
SEVERITY_OF = {"sql_injection": "CRITICAL"}


def files(spark, rows):
    return spark.createDataFrame([(p, t) for p, t in rows], "path string, text string")


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"case{k}/{path}", text) for k, (_, _, path, text, _) in enumerate(CASES)]
    out = scan.scan_frame(files(spark, rows)).select("path", "ordinal", "line").collect()
    return [(r["path"], r["ordinal"], r["line"]) for r in out]


ORDINALS = {r.name: r.ordinal for r in (*TEXT_RULES, *TREE_RULES)} | scan.MANIFEST_RULES


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(found, k):
    _, rules, path, _, expected = CASES[k]
    allowed = {ORDINALS[r] for r in rules} if rules else set(ORDINALS.values())
    got = sorted((o, n) for p, o, n in found if p == f"case{k}/{path}" and o in allowed)
    assert got == sorted((ORDINALS[r], n) for r, n in expected)


def test_registry():
    assert len(scan.REGISTRY) == 57 and sorted(ORDINALS.values()) == list(range(1, 58))


def test_every_rule_is_hit_by_the_corpus(spark):
    rows = [(s.label or f"m{k}.py", s.text) for k, s in enumerate(corpus.SNIPPETS)]
    hit = {r["ordinal"] for r in scan.scan_frame(files(spark, rows)).select("ordinal").distinct().collect()}
    assert hit == set(range(1, 58))


def test_patterns_agree_with_python(spark):
    """Java's (?U) classes against Python's re over corpus lines and Unicode edge lines."""
    patterns = sorted({m for r in TEXT_RULES for m in re.findall(r"Match\(pattern=('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"), ignore_case=(\w+)", repr(r.slots))})
    patterns = [(eval(p), i == "True") for p, i in patterns]
    edges = ["pickle.loads\u00a0(x)", "pickle.loads\u3000(x)", "passwo\u017fd = 'abcd'", "read(\u0661", "assert \u00e9in admin", "role\u0301 is admin", "MODE_ECB\u00e9", ""]
    lines = sorted({x.strip() for s in corpus.SNIPPETS for x in s.text.split("\n")}) + edges
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    columns = [F.col("line").rlike(("(?iU)" if ic else "(?U)") + p).alias(f"p{k}") for k, (p, ic) in enumerate(patterns)]
    got = {r["i"]: r for r in frame.select("i", *columns).collect()}
    for i, line in enumerate(lines):
        for k, (p, ic) in enumerate(patterns):
            assert got[i][f"p{k}"] == bool(re.search(p, line, re.I if ic else 0)), (p, line)


def test_unparsable_and_null(spark):
    deep = "x = " + "(" * 300 + "1" + ")" * 300
    assert facts(deep) is None and facts(None) is None and facts("a\0b") is None
    long = "import requests\nx = " + " + ".join(["1"] * 900) + "\nrequests.get(x)\n"
    assert facts(long)["safe_http"] == [] and facts("import requests\nx = 1 + 2\nrequests.get(x)\n")["safe_http"] == [3]
    rows = [("a.py", None), ("b.py", ""), ("c.py", "except:\n  x ("), ("d.py", deep + "\npickle.loads(x)\n")]
    out = {(r["path"], r["ordinal"]) for r in scan.scan_frame(files(spark, rows)).collect()}
    assert ("c.py", 17) in out and ("d.py", 1) in out and not {p for p, _ in out} & {"a.py", "b.py"}


def test_text_rules_alone_need_no_python(spark):
    plan = scan.scan_frame(files(spark, [("a.py", "x")]), ["pickle", "weak_hash"])._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_planning_stays_small(spark):
    """The whole registry is planned in a few seconds, however the optimiser rewrites it."""
    frame = files(spark, [("a.py", "x")])
    scan.scan_frame(frame, ["pickle"])._jdf.queryExecution().executedPlan()
    began = time.perf_counter()
    plan = scan.scan_frame(frame)._jdf.queryExecution()
    plan.executedPlan()
    assert time.perf_counter() - began < 15 and len(plan.optimizedPlan().toString()) < 400_000


def test_only_python_files_are_parsed(spark):
    rows = [("hook.pth", "# c\n"), ("requirements.txt", "eval(x)\n"), ("setup.cfg", "try:\n  a()\nexcept A:\n  pass\n"), ("m.py", "eval(x)\n"), ("n.pyi", "eval(x)\n")]
    out = [(r["path"], r["ordinal"]) for r in scan.scan_frame(files(spark, rows)).collect()]
    assert out == [("m.py", 2)]


def test_literals_lose_nothing(spark):
    """With the tests of whole texts taken away, the same findings; identifiers and letters that only look different are among the lines."""
    rows = [(f"m{k}.py", s.text) for k, s in enumerate(corpus.SNIPPETS)] + [("w.py", "\uff45val(x)\nre\uff51uests.get(u)\n"), ("f.py", "PA\u017f\u017fWORD = 'abcdefg'\nTO\u212aEN == 'x'\nap\u0131key = 'ABCDEFGHIJKLMNOP1234'\nAP\u0130KEY = 'ABCDEFGHIJKLMNOP1234'\n")]
    frame = files(spark, rows)
    gated = sorted(map(tuple, scan.scan_frame(frame).drop("text").collect()))
    add = scan._Gates.add
    scan._Gates.add = lambda self, test: add(self, None)
    try:
        every = sorted(map(tuple, scan.scan_frame(frame).drop("text").collect()))
    finally:
        scan._Gates.add = add
    # a rule for manifests or start-up files keeps its condition on the name, which isn't a literal of the text
    named = {37, 48, 50}
    assert [r for r in gated if r[2] not in named] == [r for r in every if r[2] not in named] and any(r[0] == "w.py" for r in gated)


def test_extra_columns(spark):
    rows = spark.createDataFrame([("a.py", "pickle.loads(x)", 1, "n")], "path string, text string, line int, code string")
    assert scan.scan_frame(rows, ["pickle"]).count() == 1
