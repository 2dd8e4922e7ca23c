"""The batch jobs from the command line: ``python -m postlake publish|watch|rollback|export``."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from postlake.plans import versions
from postlake.plans.clean import prepare_feed
from postlake.schema import FEED_WIDTH
from postlake.session import build_session
from postlake.sources.export import export_release
from postlake.sources.feed import prefecture_dimension, read_feed, read_zipped_feed
from postlake.streaming.jobs import publish_arrivals


def _width(value: str) -> int | None:
    return None if value == "first" else int(value)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="postlake")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("publish", "watch"):
        job = jobs.add_parser(name)
        job.add_argument("--feed", required=True, help="feed file or folder")
        job.add_argument("--store", required=True)
        job.add_argument("--zipped", action="store_true")
        job.add_argument("--encoding")
        job.add_argument("--header", action="store_true")
        job.add_argument("--merge-before-strip", action="store_true")
        job.add_argument("--trim", action="store_true")
        job.add_argument("--width", type=_width, default=FEED_WIDTH, help="fields of a line, or 'first'")
        job.add_argument("--max-deleted-ratio", type=float)
        if name == "watch":
            job.add_argument("--checkpoint", required=True)
            job.add_argument("--lists", action="store_true", help="files list the parts of a feed")
    back = jobs.add_parser("rollback")
    back.add_argument("--store", required=True)
    back.add_argument("--data-version", required=True)
    out = jobs.add_parser("export")
    out.add_argument("--store", required=True)
    out.add_argument("--out", required=True)
    out.add_argument("--format", choices=["csv", "parquet"], default="csv")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session()
    named = {"encoding": args.encoding} if getattr(args, "encoding", None) else {}
    if args.job == "publish":
        read = read_zipped_feed if args.zipped else read_feed
        records, malformed = read(
            spark, args.feed, header=args.header, joined=True, width=args.width, **named
        )
        prefectures = prefecture_dimension(spark)
        rows = prepare_feed(records, prefectures, args.merge_before_strip, args.trim)
        run = versions.publish(
            spark,
            args.store,
            rows,
            datetime.now(UTC),
            args.feed,
            rejected_lines=malformed,
            max_deleted_ratio=args.max_deleted_ratio,
        )
        print(f"{run.status}: {run.data_version}, {run.total_count} rows", file=sys.stderr)
        return 0 if run.status == "success" else 1
    if args.job == "watch":
        publish_arrivals(
            spark,
            args.feed,
            args.store,
            args.checkpoint,
            zipped=args.zipped,
            header=args.header,
            merge_before_strip=args.merge_before_strip,
            trim=args.trim,
            file_is_feed=not args.lists,
            width=args.width,
            max_deleted_ratio=args.max_deleted_ratio,
            **named,
        ).awaitTermination()
    elif args.job == "rollback":
        try:
            run = versions.rollback(spark, args.store, args.data_version)
        except ValueError as e:
            print(f"rollback failed: {e}", file=sys.stderr)
            return 1
        print(f"restored {run.total_count} rows of {args.data_version}", file=sys.stderr)
    else:
        table = versions.current(spark, args.store)
        manifest = export_release(table, args.out, datetime.now(UTC), args.format)
        manifest.write.json(f"{args.out}-manifest")
    return 0


if __name__ == "__main__":
    sys.exit(main())
