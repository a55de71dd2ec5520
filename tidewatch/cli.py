"""Command line: ingest, analyse, anomaly, evidence, sessions, cases, prioritize."""

from __future__ import annotations

import argparse
from dataclasses import replace

from .operators import anomaly, evidence, prioritize, sessions
from .plans import pipeline
from .session import build_session
from .sources import captures, pcap, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("--root", default="tidewatch-data", help="folder of the stored tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("inputs", nargs="+")
    a = sub.add_parser("analyse")
    a.add_argument("inputs", nargs="*")
    a.add_argument("--with-anomaly", action="store_true")
    b = sub.add_parser("anomaly")
    b.add_argument("--top", type=int, default=10)
    for x in (a, b):
        x.add_argument("--window-seconds", type=int, default=anomaly.WINDOW_SECONDS)
        x.add_argument("--threshold", type=float, default=anomaly.THRESHOLD)
        x.add_argument("--min-source-windows", type=int, default=anomaly.MIN_WINDOWS)
    e = sub.add_parser("evidence")
    e.add_argument("--pcap", action="append", default=[])
    e.add_argument("--tsv", action="append", default=[])
    e.add_argument("--case-id", action="append", default=[])
    e.add_argument("--limit", type=int)
    e.add_argument("--time-padding", type=float, default=2.0)
    e.add_argument("--pcap-dir", action="append", default=[], help="folder searched for captures")
    e.add_argument("--export-dir", help="folder for each case's packets, as capture files")
    e.add_argument("--show-filter", action="store_true", help="print display filters and stop")
    e.add_argument("--show", type=int, help="print so many packets in order of time")
    sub.add_parser("sessions").add_argument("--top", type=int, default=10)
    c = sub.add_parser("cases")
    c.add_argument("--top", type=int, default=25)
    r = sub.add_parser("prioritize")
    r.add_argument("--json")
    r.add_argument("--csv")
    r.add_argument("--feature-csv", help="the features of each case, one column each")
    r.add_argument("--embed-features", action="store_true", help="features as a map in the JSON")
    return p


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(**{"spark.checkpoint.dir": f"{args.root}/_scratch"})
    s = pipeline.Settings()
    if args.command in ("analyse", "anomaly"):
        anomaly.check(args.window_seconds, args.threshold, args.min_source_windows)
        s = replace(s, window_seconds=args.window_seconds, threshold=args.threshold, min_windows=args.min_source_windows)
    if args.command == "ingest" or args.command == "analyse" and args.inputs:
        pipeline.ingest(spark, args.inputs, args.root).orderBy("status", "event_type").show(100, False)
    if args.command == "analyse":
        pipeline.analyse(spark, args.root, s, args.with_anomaly)
    elif args.command == "anomaly":
        pipeline.detect_anomalies(spark, args.root, s)
        anomaly.top(tables.scan(spark, args.root, "anomaly_findings", where=f"window_seconds = {s.window_seconds}"), args.top).show(args.top, False)
    elif args.command == "evidence":
        if args.show_filter:
            pipeline.case_filters(spark, args.root, args.case_id, args.limit, args.time_padding).show(1000, False)
            return
        given = args.pcap + args.pcap_dir
        files = captures.listed(spark, *given) if given else None
        exports = [pcap.read_tsv(spark, p) for p in args.tsv]
        if not given and not exports:
            raise SystemExit("give --pcap, --pcap-dir or --tsv")
        if given and files.isEmpty():
            raise SystemExit(f"no captures in {', '.join(given)}")
        print(pipeline.link_evidence(spark, args.root, evidence.merge_packets(exports) if exports else None, replace(s, padding_seconds=args.time_padding), args.case_id, args.limit, files))
        if args.show:
            evidence.by_packet_time(tables.scan(spark, args.root, "pcap_evidence"), args.show).show(args.show, False)
        if args.export_dir:
            if not given:
                raise SystemExit("packets are exported from captures: give --pcap or --pcap-dir")
            captures.export_cases(tables.scan(spark, args.root, "pcap_evidence"), files, args.export_dir).show(1000, False)
    elif args.command == "sessions":
        sessions.largest(tables.scan(spark, args.root, "sessions"), args.top).show(args.top, False)
    elif args.command == "cases":
        tables.scan(spark, args.root, "cases").orderBy("first_us", "case_id").limit(args.top).show(args.top, False)
    elif args.command == "prioritize":
        got = tables.stored(pipeline.prioritized(spark, args.root, embed=args.embed_features), "ranked")
        got.orderBy("priority_rank").show(25, False)
        if args.json:
            tables.export_json(got, args.json)
        if args.csv:
            tables.export_csv(got.drop("features"), args.csv)
        if args.feature_csv:
            tables.export_csv(prioritize.wide(pipeline.features(spark, args.root), tables.scan(spark, args.root, "cases")), args.feature_csv)
    tables.clear(spark)


if __name__ == "__main__":
    main()
