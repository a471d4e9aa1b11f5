"""Packages as tables: entries, merges, selection and discovery are joins and groupings; links are followed by iterated joins."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.functions.lines import strip
from lintlake.operators.manifest_rules import LOCKFILES, MANIFESTS
from lintlake.plans import scan
from lintlake.sources import trees
from lintlake.tables import materialize

#: As many links as an operating system follows on the way of one path.
LINKS = 40


class UsageError(ValueError):
    """A registry, config or option that can't be used."""


def parsed(entries: DataFrame) -> DataFrame:
    """place, entry, name, given: entries (place, entry) as NAME=PATH, cut at the first sign, without white space at the ends; name is null where either is missing."""
    cut = F.instr("entry", F.lit("="))
    rows = entries.withColumn("name", strip(F.expr("left(entry, greatest(instr(entry, '=') - 1, 0))"))).withColumn("given", strip(F.expr("substring(entry, instr(entry, '=') + 1)")))
    good = (cut > 0) & (F.col("name") != "") & (F.col("given") != "")
    return rows.select("place", "entry", F.when(good, F.col("name")).alias("name"), F.when(good, F.col("given")).alias("given"))


def configured(configs: DataFrame) -> DataFrame:
    """config, place, name, given, problem: the [packages] tables of configs (config, text) in TOML, or why there is none ('toml' or 'table')."""

    def run(batches):
        for b in batches:
            out = []
            for config, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    table = tomllib.loads(text or "").get("packages")
                except tomllib.TOMLDecodeError:
                    out.append((config, None, None, None, "toml"))
                    continue
                if isinstance(table, dict):
                    out += [(config, k, name, str(given), None) for k, (name, given) in enumerate(table.items())]
                else:
                    out.append((config, None, None, None, "table"))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["config", "place", "name", "given", "problem"])

    return configs.select("config", "text").mapInArrow(run, "config string, place int, name string, given string, problem string")


def merged(base: DataFrame, over: DataFrame) -> DataFrame:
    """place, name, root: base (place, name, root) with over laid on it. A name keeps the place where it came first and gets the root that came last; new names follow."""
    last = lambda rows: rows.groupBy("name").agg(F.min("place").alias("place"), F.max_by("root", "place").alias("root"))
    old, new = last(base), last(over)
    both = old.select("name", F.col("place").alias("p"), F.col("root").alias("r")).join(new.select("name", F.col("place").alias("q"), F.col("root").alias("s")), "name", "full_outer")
    return both.select(F.struct(F.col("p").isNull().alias("later"), F.coalesce("p", "q").alias("at")).alias("place"), "name", F.coalesce("s", "r").alias("root"))


def selected(packages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packages in the order in which wanted (place, name) asks for them first, and the names (place, name) that aren't there."""
    asked = wanted.groupBy("name").agg(F.min("place").alias("place"))
    known = packages.drop("place").join(asked, "name")
    return known, asked.join(packages, "name", "left_anti").select("place", "name")


def _folded(done: Column, parts: Column) -> Column:
    """The folders of done (an array) after parts: empty parts and . stay, .. goes up."""

    def step(at, part):
        return F.when((part == "") | (part == "."), at).when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, part))

    return F.aggregate(parts, done, step)


def resolved(paths: DataFrame, links: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id, real: absolute paths (id, path) with . and .. and links followed; null where links go round in a circle.

    links: path, target, or a function that gives those of a table of paths. A round follows the first link on each path's way (.. behind a link goes up from where the
    link leads to), by one join of all prefixes with the links. A path that comes to where it was at the last power of two of rounds goes in circles, and so does
    one that is still on its way after LINKS rounds.
    """
    look = links if callable(links) else lambda prefixes: links
    none = F.array().cast("array<string>")
    text = lambda at: F.concat(F.lit("/"), F.array_join(at, "/"))
    state, done = paths.select("id", none.alias("done"), F.split("path", "/").alias("todo"), F.lit("").alias("mark")), []
    for n in range(LINKS + 1):
        step = F.transform("todo", lambda x, i: F.struct(i.alias("i"), text(_folded(F.col("done"), F.slice("todo", F.lit(1), i + 1))).alias("path")))
        ways = state.select("id", F.inline(step))
        hits = ways.join(look(ways.select("path")), "path").groupBy("id").agg(F.min(F.struct("i", "path", "target")).alias("hit"))
        state = state.join(hits, "id", "left")
        done.append(materialize(state.filter("hit IS NULL").select("id", text(_folded(F.col("done"), F.col("todo"))).alias("real")), "paths"))
        folder = F.when(F.col("hit.target").startswith("/"), none).otherwise(_folded(none, F.split(F.regexp_replace("hit.path", "/[^/]*$", ""), "/")))
        moved = state.filter("hit IS NOT NULL").select("id", folder.alias("done"), F.concat(F.split("hit.target", "/"), F.slice("todo", F.col("hit.i") + 2, F.size("todo"))).alias("todo"), "mark")
        moved = moved.withColumn("here", F.concat_ws("\0", text(F.col("done")), F.array_join("todo", "/")))
        moved = materialize(moved.withColumn("circle", F.col("here") == F.col("mark")), "paths")
        done.append(moved.filter("circle").select("id", F.lit(None).cast("string").alias("real")))
        state = moved.filter("NOT circle").select("id", "done", "todo", F.col("here" if n & (n + 1) == 0 else "mark").alias("mark"))
        if state.isEmpty():
            break
    out = state.select("id", F.lit(None).cast("string").alias("real"))
    for d in done:
        out = out.unionByName(d)
    return out


def inside(paths: DataFrame, allowed: DataFrame) -> DataFrame:
    """paths (id, real) with ok: whether each lies in or is one of the allowed folders (real); a null one doesn't."""
    parts = F.split("real", "/")
    above = paths.filter("real IS NOT NULL").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    held = above.join(allowed.select(F.regexp_replace("real", "/$", "").alias("above")).distinct(), "above", "left_semi").select("id").distinct()
    return paths.join(held.withColumn("ok", F.lit(True)), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def read_links(prefixes: DataFrame) -> DataFrame:
    """path, target of those of the paths that are links on the executors' file system."""
    import os

    def run(batches):
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                try:
                    found.append((path, os.readlink(path)))
                except OSError:
                    continue
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "target"])

    return prefixes.select("path").distinct().mapInArrow(run, "path string, target string")


def secured(packages: DataFrame, folder: str, allowed: Iterable[str]) -> DataFrame:
    """packages (place, name, given) with root, the real path of given below folder, and ok, whether it lies in one of the allowed folders."""
    spark = packages.sparkSession
    path = F.when(F.col("given").startswith("/"), F.col("given")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "given"))
    numbered = packages.withColumn("id", F.concat(F.lit("p"), F.monotonically_increasing_id().cast("string")))
    numbered = materialize(numbered.withColumn("path", path), "packages")
    folders = spark.createDataFrame([(f"a{k}", x) for k, x in enumerate(allowed)], "id string, path string")
    real = resolved(numbered.select("id", "path").unionByName(folders), read_links)
    judged = inside(real.filter("id LIKE 'p%'"), real.filter("id LIKE 'a%'"))
    return numbered.drop("path").join(judged.withColumnRenamed("real", "root"), "id").drop("id")


def discovered(spark: SparkSession, cwd: str, tree: DataFrame | None = None) -> DataFrame:
    """place, name, root, deep of what stands in cwd: each folder that is no noise and has Python sources anywhere below, and cwd itself for sources right in it.

    A folder is followed until its first source, level by level. tree: the files as a table, as in trees.listing().
    """
    cwd = cwd.rstrip("/")
    name = cwd.rpartition("/")[2]
    top = trees.listing(spark.createDataFrame([(cwd, False)], "root string, deep boolean"), tree=tree)
    python = F.col("name").endswith(".py")
    below = trees.listing(top.filter(F.col("is_dir") & ~trees.noise(F.col("name"))).select(F.col("path").alias("root"), F.lit(True).alias("deep")), until=python, tree=tree)
    folders = below.filter(python).select("root").distinct().withColumn("name", F.substring_index("root", "/", -1)).withColumn("deep", F.lit(True))
    taken = folders.filter(F.col("name") == name).agg(F.count("*").alias("taken"))
    loose = top.filter(python).agg(F.count("*").alias("n")).filter("n > 0").crossJoin(taken)  # of one row each
    own = loose.select(F.lit(cwd).alias("root"), F.when(F.col("taken") > 0, F.lit(f"{name} (root)")).otherwise(F.lit(name)).alias("name"), F.lit(False).alias("deep"))
    return folders.unionByName(own).select(F.struct((~F.col("deep")).alias("later"), F.col("name").alias("at")).alias("place"), "name", "root", "deep")


def ancestors(folders: DataFrame) -> DataFrame:
    """folder, above, depth: each folder (folder) with itself and all folders that it lies in."""
    parts = F.split("folder", "/")
    each = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")).alias("above"), n.alias("depth")))
    return folders.select("folder", F.inline(each))


def workspaces(folders: DataFrame, projects: DataFrame) -> DataFrame:
    """folder, workspace: for each folder the nearest one at or above it whose pyproject.toml (projects: dir, text) declares a workspace, if any."""

    def declares(batches):
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                try:
                    found.append("workspace" in tomllib.loads(text or "").get("tool", {}).get("uv", {}))
                except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                    found.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["above", "declares"])

    marked = projects.select(F.col("dir").alias("above"), "text").mapInArrow(declares, "above string, declares boolean").filter("declares").select("above")
    nearest = ancestors(folders).join(marked, "above").groupBy("folder").agg(F.max_by("above", "depth").alias("workspace"))
    return folders.join(nearest, "folder", "left").select("folder", "workspace")


def in_order(packages: DataFrame) -> DataFrame:
    """packages with ordinal, their number by place. A registry is a table of packages, not of files."""
    return packages.withColumn("ordinal", F.row_number().over(Window.orderBy("place")) - 1)


def package_files(packages: DataFrame, exclude: Iterable[str] = (), own: Iterable[str] = (), ceiling: str | None = None, tree: DataFrame | None = None) -> DataFrame:
    """path, package, locked of every file that packages (ordinal, name, root, deep) have: the first package that comes to a path owns it, sources before manifests.

    A manifest is that of the nearest folder at or above the root, no higher than ceiling, and belongs to the package rooted in its folder, whoever comes to it.
    """
    packages = packages.select("ordinal", "name", "root", "deep")
    listed = trees.listing(packages.select("root", "deep"), exclude, tree=tree)
    mine = trees.sources(listed, exclude, own).join(packages.select("root", "deep", "ordinal", F.col("name").alias("package")), ["root", "deep"]).select("path", "package", "ordinal", F.lit(False).alias("is_manifest"))
    up = ancestors(packages.select(F.col("root").alias("folder"))).select(F.col("above").alias("root"), F.lit(False).alias("deep"))
    beside = trees.listing(up, tree=tree).select(F.regexp_replace("root", "^/$", "").alias("dir"), "path", "name")
    manifests = beside.filter(F.col("name").isin(*MANIFESTS)).select("dir", "path")
    top = F.when((F.col("root") == ceiling) | F.col("root").startswith(f"{ceiling}/"), ceiling) if ceiling else F.lit(None).cast("string")
    near = scan.nearest_manifests(packages.select(F.col("ordinal").cast("string").alias("package"), "root", top.alias("ceiling")), manifests)
    labels = scan.manifest_labels(manifests, packages.select(F.col("name").alias("package"), "root", "ordinal"))
    more = near.join(labels, "path").select("path", F.col("label").alias("package"), F.col("package").cast("int").alias("ordinal"), F.lit(True).alias("is_manifest"))
    owned = scan.owners(mine.unionByName(more))
    locked = F.col("locked") & F.substring_index("path", "/", -1).isin(*MANIFESTS)
    return materialize(scan.with_locks(owned, beside.filter(F.col("name").isin(*LOCKFILES, "requirements.txt")).select("path").distinct()).withColumn("locked", locked), "files")


def file_count(packages: DataFrame, exclude: Iterable[str] = (), own: Iterable[str] = (), tree: DataFrame | None = None) -> DataFrame:
    """n: Python files of all packages; one that lies in two packages counts twice, manifests don't count."""
    listed = trees.sources(trees.listing(packages.select("root", "deep"), exclude, tree=tree), exclude, own).groupBy("root", "deep").agg(F.count("*").alias("n"))
    return packages.join(listed, ["root", "deep"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def read(packages: DataFrame, exclude: Iterable[str] = (), own: Iterable[str] = (), ceiling: str | None = None, tree: DataFrame | None = None) -> DataFrame:
    """path, package, locked, text of all sources and manifests of the packages."""
    return trees.contents(package_files(packages, exclude, own, ceiling, tree), tree)


def _sound(packages: DataFrame, folder: str, allowed: Iterable[str]) -> DataFrame:
    """place, name, root of packages (place, name, given); one outside of the allowed folders is an error."""
    known = materialize(secured(packages, folder, allowed), "packages")
    if bad := known.filter("NOT ok").select("name", "given").first():
        raise UsageError(f"package {bad['name']} lies outside of the allowed folders: {bad['given']}")
    return known.select("place", "name", "root")


def registry(spark: SparkSession, cwd: str, config: str | None = None, config_folder: str | None = None, entries: Iterable[str] = (), workspace: str | None = None) -> DataFrame:
    """place, name, root, deep: the packages of a TOML config (its text, and the folder it stands in) with NAME=PATH entries laid over them; without either, what is discovered in cwd."""
    entries, allowed = list(entries), [cwd, *([workspace] if workspace else [])]
    if config is None and not entries:
        return discovered(spark, cwd)
    empty = spark.createDataFrame([], "place int, name string, root string")
    base = over = empty
    if config is not None:
        rows = materialize(configured(spark.createDataFrame([("config", config)], "config string, text string")), "config")
        if bad := rows.filter("problem IS NOT NULL").first():
            raise UsageError("the config isn't TOML" if bad["problem"] == "toml" else "the config has no [packages] table")
        base = _sound(rows.select("place", "name", "given"), config_folder or cwd, [*allowed, config_folder or cwd])
    if entries:
        rows = parsed(spark.createDataFrame(list(enumerate(entries)), "place int, entry string"))
        if bad := rows.filter("name IS NULL").orderBy("place").first():
            raise UsageError(f"a package is given as NAME=PATH, not {bad['entry']!r}")
        over = _sound(rows.select("place", "name", "given"), cwd, allowed)
    return merged(base, over).withColumn("deep", F.lit(True))


def workspace_of(spark: SparkSession, folder: str) -> str | None:
    """The nearest folder at or above folder that declares a workspace."""
    at = spark.createDataFrame([(folder,)], "folder string")
    files = trees.listing(ancestors(at).select(F.col("above").alias("root"), F.lit(False).alias("deep"))).filter("name = 'pyproject.toml'")
    return workspaces(at, trees.contents(files.select(F.col("root").alias("dir"), "path"))).first()["workspace"]
