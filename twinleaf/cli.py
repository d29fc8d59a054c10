"""Command line: scan paths for clones and write reports."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Config, anchor_of, bootstrap, conf_dir, find_ignore, load_ignore, set_up_logging
from .operators.basis import with_basis
from .operators.storage import materialize
from .plans.detect import detect
from .plans.report import basis_summary, console, report_members, summary, write_reports
from .plans.store import SessionStore
from .sources.extract import fragments_of
from .sources.scan import scan, target_list


def parse_types(value: str) -> set[int]:
    """"all" or a comma list; what isn't 1, 2 or 3 is left out, unless nothing stays."""
    if value.strip().lower() == "all":
        return {1, 2, 3}
    types = {int(x) for x in value.split(",") if x.strip() in ("1", "2", "3")}
    if not types:
        raise argparse.ArgumentTypeError(f"no clone type in {value!r}")
    return types


def threshold(value: str) -> float:
    x = float(value)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("a threshold is from 0 to 1")
    return x


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("at least 1")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinleaf", description="Find exact, structural and near-duplicate code.")
    p.add_argument("path", nargs="*", help="files or folders, or with --target-list one file that lists them")
    p.add_argument("--types", type=parse_types, default={1, 2, 3}, help="all, or a list such as 1,3")
    p.add_argument("--threshold", type=threshold, default=0.8)
    p.add_argument("--output", default="twinleaf-output", help="name of the reports, without suffix")
    p.add_argument("--output-dir", default=os.path.join(os.getcwd(), "reports"))
    p.add_argument("--db-dir", default=os.path.join(os.path.expanduser("~"), ".twinleaf"), help="folder of stored sessions")
    p.add_argument("--format", choices=("json", "html", "both"), default="both")
    p.add_argument("--min-tokens", type=positive, default=10, help="least number of lines of a fragment")
    p.add_argument("--exclude", action="append", default=[], help="shell pattern of paths to leave out")
    p.add_argument("--ignore-file", help="file of gitignore rules, instead of that of the configuration folder")
    p.add_argument("--conf-dir", help="configuration folder")
    p.add_argument("--target-list", action="store_true")
    p.add_argument("--basis", help="file that lists the reference set")
    p.add_argument("--code-blocks-only", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    roots = args.path
    try:
        if args.target_list:
            if len(roots) != 1 or not os.path.isfile(roots[0]):
                raise ValueError("--target-list takes exactly one existing file")
            with open(roots[0], encoding="utf-8") as f:
                roots = target_list(f.readlines())
        if not roots:
            raise ValueError("no path given")
        basis = None
        if args.basis:
            with open(args.basis, encoding="utf-8") as f:
                basis = target_list(f.readlines())
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    roots = [os.path.realpath(r) for r in roots]
    absolute = [os.path.realpath(b) for b in basis or () if os.path.isabs(b)]
    roots += [b for b in absolute if b not in roots]
    spark = spark or SparkSession.builder.appName("twinleaf").getOrCreate()
    folder = bootstrap(args.conf_dir or conf_dir())
    log = set_up_logging(folder)
    anchor = anchor_of(roots)
    ignore = load_ignore(args.ignore_file, anchor) if args.ignore_file else find_ignore(Config(folder), anchor)
    with SessionStore(spark, args.db_dir) as store:
        session_id = store.create(roots, {"types": sorted(args.types), "threshold": args.threshold})
        try:
            return run(args, spark, store, session_id, roots, basis, absolute, ignore, log)
        finally:
            store.delete(session_id)


def run(args, spark, store, session_id, roots, basis, absolute, ignore, log) -> int:
    """Scans, extracts, detects and reports within one session."""
    files = scan(spark, roots, args.exclude, ignore)
    n_files = files.count()
    if not n_files:
        log.info("no files of a known language in %s", roots)
        print("No files of a known language found.")
        return 0
    every = materialize(fragments_of(files, args.min_tokens, args.code_blocks_only), "extracted")
    for row in every.where("error is not null").select("file_path", "error").toLocalIterator():
        log.warning("skipped %s: %s", row.file_path, row.error)
    store.save_fragments(session_id, every.where("error is null").drop("error"))
    fragments = store.fragments(session_id)
    store.save_groups(session_id, detect(fragments, args.types, args.threshold))
    found = store.detection(session_id)
    test = None
    if basis is not None:
        marked = with_basis(fragments, [b for b in absolute if os.path.isfile(b)], [b for b in absolute if os.path.isdir(b)], [b for b in basis if not os.path.isabs(b)])
        fragments, test = materialize(marked.withColumnRenamed("is_basis", "in_basis"), "marked"), F.col("in_basis")
        if not fragments.where(test).head(1):
            log.warning("no scanned file is in the basis")
    groups = materialize(report_members(found, fragments, test), "report")
    totals = summary(found, fragments, n_files)
    for path in write_reports(args.format, os.path.join(args.output_dir, args.output), groups, totals, session_id, roots, basis):
        print(path)
    print(console(totals, basis_summary(groups) if basis else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
