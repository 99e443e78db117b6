"""The repository from a shell: python -m cairnlake [--repository PATH] [--settings FILE] COMMAND ...

Commands: init, backup, list, restore, forget, prune, check. The passphrase comes from
CAIRNLAKE_PASSPHRASE, or is asked for. Exit codes: 0 done, 1 refused or failed in part, 2 misused.
Start it by spark-submit to run on a cluster; by itself it uses the session that it finds or makes.
"""

from __future__ import annotations

import argparse
import getpass
import os
import sys
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.settings import SettingsError, load
from .operators.snapshots import SnapshotError
from .sources.repository import Repository, RepositoryError

PASSPHRASE = "CAIRNLAKE_PASSPHRASE"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairnlake", description=__doc__.splitlines()[0])
    top.add_argument("--repository", help="the repository's path, instead of the settings' one")
    top.add_argument("--settings", help="a settings file")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="make an empty repository")
    commands.add_parser("backup", help="store a folder").add_argument("source")
    commands.add_parser("list", help="list snapshots, or a snapshot's paths").add_argument("ref", nargs="?")
    restore = commands.add_parser("restore", help="write a snapshot below a folder")
    restore.add_argument("ref")
    restore.add_argument("target")
    restore.add_argument("--path", default="", help="only what lies at this path")
    restore.add_argument("--overwrite", action="store_true", help="replace what is in the way")
    commands.add_parser("forget", help="remove snapshots").add_argument("refs", nargs="+")
    prune = commands.add_parser("prune", help="delete what no snapshot reaches")
    prune.add_argument("--forget", action="append", default=[], metavar="REF", help="forget a snapshot first")
    check = commands.add_parser("check", help="look for what is missing or damaged")
    check.add_argument("--read-data", action="store_true", help="read every chunk back")
    check.add_argument("--rebuild-index", action="store_true", help="make the index anew from the packs first")
    return top


def show(row) -> None:
    for name, value in row.asDict().items():
        print(f"{name:24} {value}")


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    settings = load(args.settings)
    if args.repository:
        settings = replace(settings, repository=args.repository)
    passphrase = os.environ.get(PASSPHRASE) or getpass.getpass("Passphrase: ")
    repo = Repository.from_settings(spark, passphrase, settings, create=args.command == "init")
    if args.command == "init":
        print(f"made {repo.path}")
    elif args.command == "backup":
        print(repo.backup(args.source))
        for row in repo.skipped.toLocalIterator():
            print(f"skipped {row.path}: {row.reason}", file=sys.stderr)
    elif args.command == "list" and args.ref:
        for row in repo.walk(args.ref).orderBy(F.split("path", "/")).toLocalIterator():
            print(row.path + ("/" if row.status == "OK" and row.meta.type == "dir" else "") + ("" if row.status == "OK" else f"  {row.status}"))
    elif args.command == "list":
        for row in repo.snapshots().toLocalIterator():
            made = datetime.fromtimestamp(row.created, UTC).strftime("%Y-%m-%d %H:%M:%S")
            print(f"{row.id}  {made}  {row.hostname}  {row.source_path}  {row.stats.files} files  {row.stats.bytes_read} bytes")
    elif args.command == "restore":
        done = repo.restore(args.ref, args.target, args.path, args.overwrite)
        for row in done.where("status <> 'OK' or warning is not null").toLocalIterator():
            print(f"{row.path}: {row.status}" + (f" ({row.warning})" if row.warning else ""), file=sys.stderr)
        summed = repo.restore_report(done).first()
        show(summed)
        return int(summed.failed > 0)
    elif args.command == "forget":
        for ref in args.refs:
            print(repo.forget(ref))
    elif args.command == "prune":
        for ref in args.forget:
            print(f"forgot {repo.forget(ref)}")
        show(repo.prune().first())
    elif args.command == "check":
        if args.rebuild_index:
            print(f"indexed {repo.rebuild_index()} chunks")
        row = repo.check(args.read_data).first()
        show(row)
        return int(not row.ok)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark or SparkSession.builder.appName("cairnlake").getOrCreate())
    except (RepositoryError, SnapshotError, SettingsError, OSError, LookupError) as e:
        print(f"cairnlake: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
