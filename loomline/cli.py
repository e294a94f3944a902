"""Command line: compress, restore and compare files and directories."""

from __future__ import annotations

import argparse
import os
import sys
import uuid

from loomline.operators.chunks import GEAR_SEED
from loomline.plans import archive
from loomline.session import local_session, shared_folder


def _sentence(size: int, baseline: int) -> str:
    if not baseline:
        return "(baseline size is 0, delta not meaningful)"
    pct = abs(size - baseline) / baseline * 100
    word = "SMALLER" if size < baseline else "LARGER"
    return f"archive is {abs(size - baseline):,} bytes ({pct:.1f}%) {word} than TAR+ZSTD." if size != baseline else "archive is equal in size to TAR+ZSTD."


def _report(summary: dict) -> None:
    for key in sorted(summary):
        print(f"{key}: {summary[key]}")
    print(_sentence(summary["compressed_size"], summary["tarzstd_size"]))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    names = ("compress", "decompress", "compare", "compress-dir", "decompress-dir", "compare-dir", "compress-template", "decompress-template", "compress-template-dir", "decompress-template-dir")
    for name in names:
        command = commands.add_parser(name)
        command.add_argument("source")
        if not name.startswith("compare"):
            command.add_argument("target")
        if name in ("compress", "compare", "compress-dir", "compare-dir"):
            command.add_argument("--chunking", choices=("fixed", "cdc"), default="fixed")
            command.add_argument("--delta", action="store_true")
            command.add_argument("--seed", type=os.fsencode, default=GEAR_SEED, help="seed of the content-defined chunker's byte table")
        if name in ("compress-template-dir", "compare-dir"):
            command.add_argument("--plain", action="store_true", help="use the simple tokeniser")
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command.startswith("decompress"):
        for path in archive.restore(spark, args.source, args.target):
            print(path)
        return 0
    single = args.command in ("compress", "compare")
    chunked = lambda a, b: archive.compress_chunks(spark, a, b, args.chunking, args.delta, args.seed, single)
    templated = lambda a, b: archive.compress_templates(spark, a, b, structured=not args.plain)
    filed = lambda a, b: archive.compress_file(spark, a, b)
    if not args.command.startswith("compare"):
        make = {"compress-template": filed, "compress-template-dir": templated}.get(args.command, chunked)
        _report(make(args.source, args.target))
        return 0
    bad, work = 0, f"{shared_folder(spark)}/compare-{uuid.uuid4().hex}"
    for name, make in (("templates", filed if single else templated), ("chunks", chunked)):
        print(f"[{name}]")
        _report(make(args.source, f"{work}-{name}"))
        bad += archive.differences(spark, args.source, f"{work}-{name}", single).count()
    print("round trip: " + ("exact" if not bad else f"{bad} files differ"))
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
