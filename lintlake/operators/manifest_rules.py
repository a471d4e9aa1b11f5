"""The two rules over dependency manifests: known vulnerable versions, and pins without an upper bound."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MANIFESTS = ("pyproject.toml", "requirements.txt", "setup.py", "Pipfile")
LOCKFILES = ("uv.lock", "poetry.lock", "Pipfile.lock")
PINNED = MANIFESTS[:2] + MANIFESTS[3:]
VERSION = r"(?U)(?:>=|==|~=|!=|<|>)\s*(\d+\.\d+\.\d+)"
LOWER_BOUND = r"(?U)[\"']([\w.-]+)\s*>=\s*(\d+\.\d+(?:\.\d+)?)[\"']"


# Package, first sound version, advisory.
VULNERABLE = (
    ("urllib3", (1, 26, 19), "CVE-2024-37891"),
    ("requests", (2, 32, 0), "CVE-2024-35195"),
    ("cryptography", (42, 0, 0), "CVE-2024-26131"),
    ("jinja2", (3, 1, 5), "CVE-2025-27516"),
    ("werkzeug", (3, 0, 6), "CVE-2024-49766"),
    ("dask", (2024, 8, 1), "CVE-2024-45187"),
    ("pyarrow", (15, 0, 2), "CVE-2024-39135"),
    ("pandas", (2, 2, 1), "CVE-2024-42992"),
    ("aiohttp", (3, 10, 11), "CVE-2024-52304"),
    ("fsspec", (2024, 10, 0), "CVE-2024-40332"),
)


def version(line: Column) -> Column:
    """The first three-part version of a line as an array of numbers; null where there is none."""
    text = F.regexp_extract(line, VERSION, 1)
    return F.when(text != "", F.transform(F.split(text, r"\."), lambda x: x.try_cast("decimal(38,0)")))


def older(line: Column, bound: tuple[int, ...]) -> Column:
    return F.coalesce(version(line) < _parts(bound), F.lit(False))


def _parts(bound: tuple[int, ...]) -> Column:
    return F.array(*(F.lit(x).cast("decimal(38,0)") for x in bound))


def _name_pattern(name: str) -> str:
    return r"(?U)(?:^|[\"'=,\s])" + re.escape(name) + r"(?=[\"':,<>=!\s]|$)"


def vulnerable(lines: Column) -> Column:
    """For each row of the table the number of the first line that names an older version: array of (entry, number), null where there is none."""
    read = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("number"), F.lower(x).alias("low"), version(x).alias("version")))
    stated = F.filter(read, lambda x: x["version"].isNotNull())
    entries = F.array(*(F.struct(F.lit(k).alias("entry"), F.lit(_name_pattern(n)).alias("pattern"), _parts(v).alias("sound")) for k, (n, v, _) in enumerate(VULNERABLE)))
    first = lambda e: F.try_element_at(F.filter(stated, lambda x: F.rlike(x["low"], e["pattern"]) & (x["version"] < e["sound"])), F.lit(1))["number"]
    return F.transform(entries, lambda e: F.struct(e["entry"].alias("entry"), first(e).alias("number")))


def loose(code: Column) -> Column:
    """Whether a stripped line sets a lower bound without an upper one."""
    name = F.regexp_extract(code, LOWER_BOUND, 1)
    return ~code.startswith("#") & code.rlike(LOWER_BOUND) & ~name.isin("python", "requires-python") & ~code.contains("<")
