"""python -m sessionmill {list,export,stream} ...: session logs from the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from sessionmill.exports.fragments import write_export
from sessionmill.exports.write import FILES, exported, stream_text, write_dataset, write_folder
from sessionmill.operators import sessions as S
from sessionmill.plans.adapters import scratch
from sessionmill.plans.api import UnknownSession
from sessionmill.sources.logs import expand, read_events


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sessionmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("list", "print session facts as JSON"), ("export", "write sessions in a training format"), ("stream", "print session facts as logs grow")):
        c = commands.add_parser(name, help=what)
        c.add_argument("-w", "--root", default=os.environ.get("SESSIONMILL_ROOT", "."), help="folder of logs (SESSIONMILL_ROOT)")
    e = commands.choices["export"]
    e.add_argument("-f", "--format", choices=sorted(FILES), default="messages")
    e.add_argument("-s", "--session", action="append", help="a session id; all sessions without it")
    e.add_argument("-o", "--out", help="file; or with --folder, or for huggingface, a folder")
    e.add_argument("--folder", action="store_true", help="write part files in parallel")
    e.add_argument("--min-events", type=int, default=1)
    e.add_argument("--max-events", type=int, default=S.SESSION_RING, help="of each session the last so many; 0 for all")
    s = commands.choices["stream"]
    s.add_argument("--feed", action="store_true", help="print events: the last 500, then each as it arrives")
    s.add_argument("--from-end", action="store_true", help="skip what is already there")
    s.add_argument("--seconds", type=float, help="stop after so long")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "export" and args.format == "huggingface" and not args.out:
        print("huggingface needs --out", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sessionmill").config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()
    if args.command == "stream":
        from sessionmill.sources.tail import tail_events
        from sessionmill.streaming.live import follow, live_facts

        if args.feed:
            shown = ["session_id", "line_index", "event_type", "observed_at", "summary"]
            # A new folder each time, as a feed starts anew.
            query = follow(spark, args.root, lambda rows: [print(r, flush=True) for r in rows.orderBy("observed_at", "seq").select(*shown).toJSON().toLocalIterator()], scratch(spark))
            query.awaitTermination(args.seconds) if args.seconds else query.awaitTermination()
            query.stop()
            return 0
        facts = live_facts(tail_events(spark, args.root, "latest" if args.from_end else "earliest"))
        query = facts.writeStream.outputMode("update").format("console").start()
        query.awaitTermination(args.seconds) if args.seconds else query.awaitTermination()
        query.stop()
        return 0
    events = read_events(spark, expand(args.root))
    facts = S.sessions(events)
    if args.command == "list":
        rows = S.order_sessions(facts).toJSON().toLocalIterator()
        print("[" + ",\n ".join(json.dumps(json.loads(r), ensure_ascii=False) for r in rows) + "]")
        return 0
    chosen = S.with_min_events(S.select_sessions(facts, args.session), args.min_events)
    if chosen.isEmpty():
        print(str(UnknownSession("no session matches")), file=sys.stderr)
        return 1
    keep = args.max_events or None
    if args.format == "huggingface":
        write_dataset(events, chosen, expand(args.out), keep)
        return 0
    if args.out and not args.folder:
        write_export(events, chosen, args.format, expand(args.out), keep)
        return 0
    rows = exported(events, chosen, args.format, keep)
    if args.out:
        write_folder(rows, expand(args.out))
    else:
        sys.stdout.writelines(stream_text(rows, args.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
