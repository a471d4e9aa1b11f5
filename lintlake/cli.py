"""The command line: python -m lintlake.cli [options]. Exit code 1 where a finding reaches --fail-on, 2 for wrong usage."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lintlake import __version__, plugins, report
from lintlake.plans import isolation, registry, scan
from lintlake.sources import trees
from lintlake.sources.baselines import read_baseline, write_baseline
from lintlake.tables import materialize


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lintlake", description="Scan Python sources for security problems with Spark.")
    p.add_argument("--version", action="version", version=f"lintlake {__version__}")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--quiet", "-q", action="store_true", help="no banner, no warnings")
    p.add_argument("--config", type=Path, help="TOML file with a [packages] table")
    p.add_argument("--package", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--packages", nargs="*", metavar="NAME", help="scan these packages only, in this order")
    p.add_argument("--exclude", nargs="*", default=[], metavar="PART", help="leave out paths that contain any of these")
    p.add_argument("--fail-on", default="high", choices=("critical", "high", "medium", "low", "info"))
    p.add_argument("--confidence-min", default="low", choices=("high", "medium", "low"))
    p.add_argument("--include-tests", action="store_true")
    p.add_argument("--test-paths", nargs="*", default=[], metavar="DIR", help="further names of test folders")
    p.add_argument("--baseline", metavar="FILE")
    p.add_argument("--write-baseline", metavar="FILE")
    return p


#: Sources of this package that hold patterns rather than code that is run on anything.
OWN = tuple(f"lintlake/{x}" for x in ("operators/text_rules.py", "operators/tree_rules.py", "operators/manifest_rules.py", "operators/facts.py", "corpus.py", "report.py"))


def config_text(path: Path | None) -> tuple[str | None, str | None]:
    """The text of a config and the folder it stands in."""
    if path is None:
        return None, None
    try:
        return path.read_text(), str(path.resolve().parent)
    except (OSError, UnicodeDecodeError) as e:
        raise registry.UsageError(f"can't read {path}: {e}") from e


def main(argv: list[str] | None = None, cwd: Path | None = None, spark: SparkSession | None = None, workspace: Path | None = None) -> int:
    """workspace: the root that shown paths are relative to and manifests aren't looked for above; by default the workspace that this package is installed in, if any."""
    p = parser()
    args, cwd = p.parse_args(argv), (cwd or Path.cwd()).resolve()
    exclude = [*args.exclude, *(() if args.config or args.package else trees.DEFAULT_EXCLUDES)]
    spark = spark or SparkSession.builder.appName("lintlake").getOrCreate()
    workspace = str(workspace) if workspace else registry.workspace_of(spark, str(Path(__file__).resolve().parent))
    try:
        packages = registry.registry(spark, str(cwd), *config_text(args.config), entries=args.package, workspace=workspace)
        if args.packages is not None:
            wanted = spark.createDataFrame(list(enumerate(args.packages)), "place int, name string")
            packages, unknown = registry.selected(packages, wanted)
            if unknown := [r["name"] for r in unknown.orderBy("place").collect()]:  # of the names on the command line
                raise registry.UsageError(f"unknown packages: {', '.join(unknown)}")
        packages = materialize(registry.in_order(packages), "packages")
        if args.packages is None and packages.isEmpty():
            raise registry.UsageError("there is no package to scan")
    except registry.UsageError as e:
        p.error(str(e))
    say = lambda text: None if args.quiet else print(text, file=sys.stderr)
    files = materialize(registry.read(packages, exclude, OWN, workspace), "texts")
    if not args.quiet and not args.json:
        print(f"  Scanning {registry.file_count(packages, exclude, OWN).first()['n']} file(s) in {packages.count()} package(s)")
    found = plugins.discover(say)
    extra = [r for r in found if isinstance(r, scan.Rule)]
    options = {"confidence_min": args.confidence_min, "include_tests": args.include_tests, "test_dirs": args.test_paths, "root": workspace}
    baseline = read_baseline(spark, args.baseline) if args.baseline and not args.write_baseline else None
    guarded = isolation.guarded(files, None, extra)
    for e in guarded.errors.toLocalIterator():
        say(f"warning: rule {e['rule']} failed on {e['path']}: {e['error']}")
    scanned = scan.judged(guarded.candidates, baseline, keep=True, **options)
    more = []
    if by_facts := [r for r in found if isinstance(r, plugins.FactRule)]:
        more.append(plugins.run_fact_rules(files, by_facts))
    if procedural := {getattr(f, "__name__", str(k)): f for k, f in enumerate(found) if not isinstance(f, scan.Rule | plugins.FactRule)}:
        rows, errors = plugins.run_procedural(files, procedural)
        for e in errors.toLocalIterator():
            say(f"warning: rule {e['rule']} failed on {e['path']}: {e['error']}")
        more.append(rows)
    for rows in more:
        kept = scan.marked(rows, **options).filter("fate = 'kept'")
        scanned.findings = scanned.findings.unionByName(kept if baseline is None else scan.without_baseline(kept, baseline))
    scanned.findings = scanned.findings.cache()
    if args.write_baseline:
        n = write_baseline(scanned.findings, str(Path(args.write_baseline).absolute()))
        (report.as_json if args.json else report.as_text)(scanned)
        if not args.quiet and not args.json:
            print(f"  Wrote {n} fingerprint(s) to {args.write_baseline}")
        return 0
    (report.as_json if args.json else report.as_text)(scanned)
    return int(scan.fails(scanned.findings, args.fail_on))


if __name__ == "__main__":
    sys.exit(main())
