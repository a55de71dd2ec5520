import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import net, values
from tidewatch.functions.net import community_id, is_internal
from tidewatch.functions.values import json_ids, modified_z, parse_time, safe_name
from tidewatch.operators import anomaly, correlation, evidence, prioritize, rules, sessions
from tidewatch.plans import pipeline
from tidewatch.schemas import ContractError, require_columns
from tidewatch.sources import ndjson, pcap, tables

BASE = 1_780_000_000_000_000
EVENT = "id long, us long, flow_start_us long, flow_end_us long, event_type string, flow_id long, src_ip string, src_port int, dest_ip string, dest_port int, proto string, raw string"


def event(i, second, src="10.0.0.1", dest="192.168.0.5", port=80, flow=None, kind="flow", raw=None, end=None):
    us = BASE + int(second * 1_000_000)
    return (i, us, us, us if end is None else BASE + int(end * 1_000_000), kind, i if flow is None else flow, src, 4000, dest, port, "TCP", raw)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def test_window_edge_counts_and_one_microsecond_more_does_not(spark):
    rule = rules.Rule("R01", "x", 3, 60)
    at_edge = frame(spark, [event(1, 0), event(2, 1), event(3, 60)])
    assert [r.total_flows for r in rules.high_connection_rate(at_edge, rule).collect()] == [3]
    beyond = frame(spark, [event(1, 0), event(2, 1), event(3, 60.000001)])
    assert rules.high_connection_rate(beyond, rule).count() == 0


def test_rows_at_one_time_and_chained_episodes(spark):
    rule = rules.Rule("R01", "x", 2, 10)
    same = frame(spark, [event(1, 0), event(2, 0)])
    assert rules.high_connection_rate(same, rule).first().max_value == 2
    chain = frame(spark, [event(i, 10 * i) for i in range(6)])
    got = rules.high_connection_rate(chain, rule).collect()
    assert [(r.start_us, r.end_us, r.total_flows) for r in got] == [(BASE, BASE + 50_000_000, 6)]
    apart = frame(spark, [event(1, 0), event(2, 5), event(3, 16), event(4, 20)])
    assert rules.high_connection_rate(apart, rule).count() == 2


def test_multi_port_needs_inbound_and_distinct_ports(spark):
    rows = [event(i, i, port=p) for i, p in enumerate((80, 80, 443, 22))]
    got = rules.multi_port(frame(spark, rows)).collect()
    assert [(r.max_value, r.destination_ports) for r in got] == [(3, [22, 80, 443])]
    assert rules.multi_port(frame(spark, [event(i, i, src="192.168.0.9", port=i) for i in range(5)])).count() == 0


def test_failed_logins_read_scalar_and_list_replies_and_stop_at_the_first_window(spark):
    raw = '{"ftp":{"reply":["530 Login incorrect."]}}'
    single = '{"ftp":{"reply":"Login incorrect"}}'
    rows = [event(i, i, kind="ftp", raw=raw if i % 2 else single) for i in range(4)] + [event(10 + i, 100 + i, kind="ftp", raw=raw) for i in range(4)] + [event(30, 3, kind="ftp", raw='{"ftp":{"reply":"230 ok"}}')]
    got = rules.failed_authentication(frame(spark, rows)).collect()
    assert [(r.start_us, r.max_value, r.event_ids) for r in got] == [(BASE, 4, [0, 1, 2, 3])]


def test_protocol_anomalies_name_their_types(spark):
    rows = [event(i, i, kind="anomaly", raw=f'{{"anomaly":{{"event":"t{i}"}}}}') for i in range(2)]
    assert rules.protocol_anomaly(frame(spark, rows)).first().anomaly_types == ["t0", "t1"]


def test_hot_source_windows_equal_a_plain_model(spark):
    rng = np.random.default_rng(1)
    rows = [event(i, float(s), src="10.0.0.%d" % (0 if rng.random() < 0.6 else rng.integers(1, 4)), port=int(rng.integers(1, 6))) for i, s in enumerate(np.sort(rng.integers(0, 4000, 600)))]
    rule = rules.Rule("R02", "x", 3, 20)
    want = []
    for src in sorted({r[6] for r in rows}):
        mine = [r for r in rows if r[6] == src]
        chains = []
        for r in mine:
            win = [x for x in mine if r[1] <= x[1] <= r[1] + 20_000_000]
            if len({x[9] for x in win}) >= 3:
                if chains and r[1] <= chains[-1][1]:
                    chains[-1][1] = max(chains[-1][1], win[-1][1])
                else:
                    chains.append([r[1], win[-1][1]])
        want += [(src, a, b, sum(a <= x[1] <= b for x in mine)) for a, b in chains]
    got = sorted((r.source_ip, r.start_us, r.end_us, r.total_flows) for r in rules.multi_port(frame(spark, rows), rule).collect())
    assert got == want and len(want) > 5


@pytest.mark.parametrize("distinct", [None, "v"])
def test_sweeps_equal_counting_each_window(spark, distinct):
    """Dense bursts with many ties, values that return, and null values."""
    from tidewatch.operators.ranges import chained, counted

    rng, width = np.random.default_rng(3), 7
    rows = [(k, "ab"[int(rng.random() < 0.3)], int(t), None if v > 4 else int(v)) for k, (t, v) in enumerate(zip(np.concatenate([rng.integers(0, 60, 120), rng.integers(0, 2000, 200), rng.integers(700, 712, 80)]), rng.integers(0, 7, 400), strict=True))]
    df = spark.createDataFrame(rows, "id long, s string, at long, v int")
    inside = lambda r: [x for x in rows if x[1] == r[1] and r[2] <= x[2] <= r[2] + width]
    assert {r.id: r.value for r in counted(df, "s", "at", width).collect()} == {r[0]: len(inside(r)) for r in rows}
    want = {}
    for s in "ab":
        chains, mine = [], sorted(x for x in rows if x[1] == s)
        value = {x[0]: len({y[3] for y in inside(x)} - {None}) if distinct else len(inside(x)) for x in mine}
        for x in sorted(mine, key=lambda x: x[2]):
            if value[x[0]] >= 3:
                end = max(y[2] for y in inside(x))
                if chains and x[2] <= chains[-1][1]:
                    chains[-1][1] = max(chains[-1][1], end)
                else:
                    chains.append([x[2], end])
        for x in mine:
            for a, b in chains:
                if a <= x[2] <= b:
                    want[x[0]] = (a, value[x[0]] if value[x[0]] >= 3 else None)
    assert {r.id: (r.episode, r.value) for r in chained(df, "s", "at", width, 3, distinct).collect()} == want and len(want) > 100


def test_session_gap_is_inclusive(spark):
    rows = [event(1, 0, end=10), event(2, 310), event(3, 610.000001, flow=3)]
    got = sessions.sessions(sessions.flows(frame(spark, rows))).orderBy("session_id").collect()
    assert [r.flow_ids for r in got] == [[1, 2], [3]]
    v = sessions.validation(sessions.flows(frame(spark, rows)), sessions.sessions(sessions.flows(frame(spark, rows)))).first()
    assert v.valid and v.assigned == 3


def test_cases_join_transitively_and_keep_single_findings(spark):
    parts = [event(i, i, kind="flow") for i in range(25)] + [event(100 + i, 200 + i, kind="anomaly", flow=i) for i in range(2)] + [event(200 + i, 90_000 + i, src="10.9.9.9", kind="flow") for i in range(20)]
    found = pipeline.detect(frame(spark, parts))
    rel = correlation.relations(found)
    assert {r.strength for r in rel.collect()} == {"Strong"}
    got = correlation.cases(found, rel).orderBy("case_id").collect()
    assert [(c.finding_count, c.correlation_strength) for c in got] == [(2, "Strong"), (1, "Single")]


def test_anomaly_scenarios(spark):
    def windows(burst):
        rows = [(f"203.0.113.10", k, 30 if k == burst else 3) for k in range(11)] + [("198.51.100.20", k, 2) for k in range(11)]
        out, i = [], 0
        for src, k, n in rows:
            for j in range(n):
                i += 1
                out.append(event(i, 60 * k + j, src=src, dest=f"192.168.0.{j % 10}", port=j))
        return frame(spark, out)

    def run(e):
        w = anomaly.windows(e)
        f = anomaly.findings(w, anomaly.baselines(w))
        return f, anomaly.linked_events(e, f)

    f, links = run(windows(10))
    assert {"event_count", "unique_destinations"} <= {r.metric for r in f.collect()} and links.count() > 0
    assert {r.status for r in f.collect()} == {"candidate_for_investigation"}
    f, links = run(windows(None))
    assert f.count() == 0 and links.count() == 0
    with pytest.raises(ValueError):
        anomaly.check(0, 1, 2)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("192.168.0.255", "2026-06-20T17:11:21.051956+0000"), ("192.168.1.1", "2026-06-20T19:11:21.051956+02:00"), ("192.168.0.300", "junk"), (None, "2026-06-20T17:11:21.051956Z"), ("fe80::1", "2026-06-20 17:11:21.051956")], "ip string, ts string")
    got = df.select(is_internal(F.col("ip")).alias("i"), parse_time(F.col("ts")).alias("t")).collect()
    assert [r.i for r in got] == [True, False, False, False, False]
    assert len({r.t for r in got if r.t}) == 1 and got[2].t is None
    one = spark.range(1).select(
        community_id(F.lit("66.35.250.204"), F.lit(80), F.lit("128.232.110.120"), F.lit(34855), F.lit("tcp")).alias("c"), json_ids(F.lit("[1.0, 2]")).alias("j"), json_ids(F.lit("x")).alias("k"), safe_name(F.lit(" A b-c/d ")).alias("s"),
        modified_z(F.lit(5.0), F.lit(3.0), F.lit(1.0)).alias("z"), community_id(F.lit("fe80::1"), F.lit(1), F.lit("fe80::2"), F.lit(2), F.lit("UDP"), ipv6=True).alias("v6")).first()
    assert (one.c, one.j, one.k, one.s, round(one.z, 4)) == ("1:LQU9qZlK+B5F3KDmev6m5PMibrg=", [1, 2], [], "a_b_c_d", 1.349)
    assert one.v6.startswith("1:")
    with pytest.raises(ContractError):
        require_columns(df, ["ip", "nope"])


def test_ingest_is_idempotent_and_counts_lines(spark, tmp_path):
    lines = ['{"timestamp":"2026-06-20T17:11:21.051956+0000","event_type":"flow","flow_id":100801491427561,"src_ip":"10.0.0.1","src_port":1,"dest_ip":"192.168.0.2","dest_port":2,"proto":"TCP","flow":{"start":"2026-06-20T17:11:20+0000"}}', "", "{broken", '{"event_type":"flow"}', '{"timestamp":"2026-06-20T17:11:22Z","event_type":"stats"}', '{"timestamp":"2026-06-20T17:11:22Z","event_type":"ssh","a":1,"a":2}']
    (tmp_path / "eve.json").write_text("\n".join(lines) + "\n")
    first = {(r.status, r.event_type): (r.lines, r.new_rows) for r in pipeline.ingest(spark, str(tmp_path / "eve.json"), str(tmp_path / "db")).collect()}
    assert first[("event", "flow")] == (1, 2) and first[("malformed", None)][0] == 1 and first[("skipped", "stats")][0] == 1 and first[("blank", None)][0] == 1
    again = pipeline.ingest(spark, str(tmp_path / "eve.json"), str(tmp_path / "db")).first()
    assert again.new_rows == 0
    e = tables.scan(spark, str(tmp_path / "db"), "events").orderBy("line_no").collect()
    assert [r.line_no for r in e] == [1, 6] and e[0].flow_id == 100801491427561 and e[0].community_id.startswith("1:")


def test_only_files_read_again_are_compared_with_stored_events(spark, tmp_path, monkeypatch):
    line = lambda n: f'{{"timestamp":"2026-06-20T17:11:22Z","event_type":"flow","flow_id":{n}}}\n'
    root, compared = str(tmp_path / "db"), []
    append, append_new = tables.append, tables.append_new
    monkeypatch.setattr(tables, "append_new", lambda df, root, table, *a, **k: compared.append((table, k.get("among"))) or append_new(df, root, table, *a, **k))
    for name, flows in (("a", (1, 2)), ("b", (3,)), ("c", ()), ("d", (4,))):
        (tmp_path / f"{name}.json").write_text("".join(map(line, flows)))
    ingest = lambda *names: pipeline.ingest(spark, [f"{tmp_path}/{n}.json" for n in names], root)
    assert ingest("a", "b", "a", "c").first().new_rows == 3 and compared == [("files", None)]
    assert {r.lines for r in ingest("d").collect()} == {1} and compared == [("files", None)] * 2
    with (tmp_path / "b.json").open("a") as f:  # a log that grew, beside a new one
        f.write(line(5) + line(6))
    (tmp_path / "e.json").write_text(line(7))
    assert ingest("b", "e").first().new_rows == 3
    first = 2 << 36
    assert compared[2:] == [("files", None), ("events", f"id >= {first} and id < {first + (1 << 36)}")]
    assert ingest("a", "b", "c", "d", "e").first().new_rows == 0
    got = tables.scan(spark, root, "events").select("flow_id", "id", "line_no").collect()
    assert sorted(r.flow_id for r in got) == list(range(1, 8)) and len({r.id for r in got}) == 7
    assert {r.flow_id: r.line_no for r in got if r.flow_id in (3, 5, 6)} == {3: 1, 5: 2, 6: 3}
    # a run that broke off after it had numbered its files
    (tmp_path / "f.json").write_text(line(8))
    with monkeypatch.context() as m:
        m.setattr(tables, "append", lambda df, root, table, *a: append(df, root, table, *a) if table == "files" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest("f")
    assert ingest("f").first().new_rows == 1 and ingest("f").first().new_rows == 0
    plan = spark.read.parquet(f"{root}/events").where(compared[-1][1])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id," in plan and "LessThan(id," in plan


def test_scratch_of_one_thread_is_not_another_s(spark):
    kept = tables.stored(spark.range(5), "kept")
    other = threading.Thread(target=lambda: (tables.stored(spark.range(1), "other"), tables.clear(spark)))
    other.start()
    other.join()
    assert kept.count() == 5 and len(tables._scratch.paths) > 0


def test_events_without_a_readable_time_are_stored(spark, tmp_path):
    rows = ['{"timestamp":"soon","event_type":"flow","flow_id":7,"src_ip":"10.0.0.1","dest_ip":"192.168.0.2"}', '{"timestamp":null,"event_type":"flow","flow_id":8}', '{"timestamp":"2026-06-20T17:11:22Z","event_type":"flow","flow_id":9,"src_ip":"10.0.0.1","dest_ip":"192.168.0.2"}']
    (tmp_path / "eve.json").write_text("\n".join(rows))
    root = str(tmp_path / "db")
    assert pipeline.ingest(spark, str(tmp_path / "eve.json"), root).first().new_rows == 3
    assert [(r.flow_id, r.ts_raw, r.us is None) for r in tables.scan(spark, root, "events").orderBy("flow_id").collect()] == [(7, "soon", True), (8, None, True), (9, "2026-06-20T17:11:22Z", False)]
    pipeline.analyse(spark, root, with_anomaly=True)
    assert [r.flow_ids for r in tables.scan(spark, root, "sessions").collect()] == [[9]]


def test_runs_are_published_at_once(spark, tmp_path):
    root, df = str(tmp_path / "db"), spark.range(3)
    for k in range(4):
        run = tables.new_run()
        for name in ("a", "b"):
            tables.replace(df.withColumn("k", F.lit(k)), f"{root}/{run}", name)
            if k:
                assert tables.scan(spark, root, name).first().k == k - 1
        began = tables.scan(spark, root, "a") if k else None
        tables.publish(spark, root, run, ("a", "b"))
        assert {tables.scan(spark, root, n).first().k for n in ("a", "b")} == {k}
        assert began is None or began.first().k == k - 1
        assert len(list((tmp_path / "db" / "_runs").iterdir())) == min(k + 1, 2)
    for seconds in ("60", "300", "60"):
        run = tables.new_run()
        tables.replace(df.withColumn("w", F.lit(int(seconds))), f"{root}/{run}", "c")
        tables.publish(spark, root, run, ("c",), seconds)
    assert sorted(r.w for r in tables.scan(spark, root, "c").collect()) == [60] * 3 + [300] * 3
    assert tables.scan(spark, root, "a").first().k == 3 and not [p for p in (tmp_path / "db").iterdir() if p.name.startswith("_current-")]


def test_line_numbers_hold_when_files_are_split(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(f"row {i}" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        x = ndjson.numbered_lines(spark, str(tmp_path / "a.json"))
        assert x.rdd.getNumPartitions() > 1
        assert x.where("raw <> concat('row ', line_no)").count() == 0 and x.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_whole_run_and_evidence(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = [event(i, i % 50, port=80 + i % 4) for i in range(30)] + [event(50 + i, 30 + i, kind="anomaly") for i in range(3)]
    frame(spark, rows).withColumns({"source_file": F.lit("f"), "line_no": F.col("id")}).write.parquet(f"{root}/events")
    pipeline.analyse(spark, root, with_anomaly=True)
    assert tables.scan(spark, root, "cases").count() >= 1 and tables.scan(spark, root, "anomaly_windows").count() >= 1
    packets = spark.createDataFrame([("cap.pcap", 1, BASE / 1e6 + 1, "192.168.0.5", 80, "10.0.0.1", 4000), ("cap.pcap", 2, BASE / 1e6 + 9e6, "192.168.0.5", 80, "10.0.0.1", 4000)], "pcap_path string, packet_number long, packet_epoch double, src_ip string, src_port int, dest_ip string, dest_port int")
    links, new = pipeline.link_evidence(spark, root, packets)
    assert links == 33 and new == 1
    assert pipeline.link_evidence(spark, root, packets) == (0, 0)
    assert tables.scan(spark, root, "pcap_evidence").first().direction == "reverse"
    ranked = pipeline.prioritized(spark, root, trees=20)
    tables.export_csv(ranked, f"{root}/ranked.csv")
    assert spark.read.option("header", "true").csv(f"{root}/ranked.csv").count() == ranked.count()


def test_forest_puts_planted_outliers_first():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 4)), np.full((3, 4), 9.0)])
    s = prioritize.IsolationForest(x, trees=100).score(x)
    assert set(np.argsort(-s)[:3]) == {300, 301, 302} and s[300] > 0.5


def test_tsv_exports(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\t1780000000.5\t10.0.0.1\t\t192.168.0.5\t\t4000\t\t80\t\tTCP\n\t5\n2\tx\n")
    got = pcap.read_tsv(spark, str(tmp_path / "p.tsv")).collect()
    assert [(g.packet_number, g.dest_port, g.packet_us, g.dns_query) for g in got] == [(1, 80, 1_780_000_000_500_000, None)]


def test_capture_choice_prefers_the_date(spark):
    c = spark.createDataFrame([("CASE-0001", 1_781_000_000_000_000), ("CASE-0002", 1_700_000_000_000_000)], "case_id string, first_us long")
    caps = spark.createDataFrame([("/a/dump-2026-06-09.pcap",), ("/a/other.pcap",)], "pcap_path string")
    got = sorted((r.case_id, r.pcap_path) for r in evidence.capture_assignment(c, caps).collect())
    assert got == [("CASE-0001", "/a/dump-2026-06-09.pcap"), ("CASE-0002", None)]
    rows = spark.createDataFrame([("CASE-0001", "/a/other.pcap", 1), ("CASE-0001", "/a/dump-2026-06-09.pcap", 2), ("CASE-0002", "/a/other.pcap", 3)], "case_id string, pcap_path string, packet_number long")
    assert sorted(r.packet_number for r in evidence.in_assigned(rows, evidence.capture_assignment(c, caps)).collect()) == [2, 3]


def test_streams_agree_with_batch(spark, tmp_path):
    from tidewatch.streaming import live

    src = str(tmp_path / "in")
    rows = [event(i, i * 7) for i in range(40)]
    batch = frame(spark, rows).withColumns({"ts": F.timestamp_micros("us"), "flow_start": F.timestamp_micros("us"), "flow_end": F.timestamp_micros("us")})
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = live.live_windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = sorted((r.src_ip, r.epoch, r.event_count) for r in anomaly.windows(frame(spark, rows)).collect())
    assert sorted((r.src_ip, r.epoch, r.event_count) for r in spark.table("w").collect()) == want
    s = live.live_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("s").start()
    s.processAllAvailable()
    s.stop()
    assert spark.table("s").count() == sessions.sessions(sessions.flows(frame(spark, rows))).count()


def test_dashboard_helpers(spark):
    from tidewatch.functions.values import display_time, or_na
    from tidewatch.operators import dashboard

    e = frame(spark, [event(i, i * 86_400) for i in range(20)])
    order = ["us", "id"]
    assert [r.id for r in dashboard.page(e, 99, order).collect()] == [16, 17, 18, 19]
    assert [r.id for r in dashboard.page(e, -1, order).collect()] == list(range(8))
    assert dashboard.timeframe(e, hours=48).count() == 3 and dashboard.timeframe(e, year=1999).count() == 0
    assert dashboard.search(e, "").count() == 20 and dashboard.search(e, "10\\.0\\.0", ["src_ip"]).count() == 20
    assert dashboard.timeframe(e.limit(0), hours=24).count() == 0
    x = dashboard.with_missing(e.select("src_ip"), {"src_ip": "Source", "nope": "Nothing"}).select(or_na(F.col("Nothing")).alias("n"), "Source").first()
    assert (x.n, x.Source) == ("N/A", "10.0.0.1")
    assert spark.range(1).select(display_time(F.timestamp_micros(F.lit(0))).alias("t")).first().t == "1970-01-01 00:00:00 UTC"
    two = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "pcap_path string, packet_number long")
    assert evidence.merge_packets([two, two]).count() == 2


def test_empty_events_give_empty_tables(spark, tmp_path):
    root = str(tmp_path / "db")
    frame(spark, []).write.parquet(f"{root}/events")
    pipeline.analyse(spark, root, with_anomaly=True)
    assert {t: tables.scan(spark, root, t).count() for t in ("sessions", "findings", "cases", "anomaly_findings")} == dict.fromkeys(("sessions", "findings", "cases", "anomaly_findings"), 0)
    assert pipeline.prioritized(spark, root, trees=5).count() == 0


def test_ipv6_bytes_equal_the_library(spark):
    import ipaddress

    good = ["::", "::1", "fe80::1", "2001:DB8::", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "64:ff9b::192.0.2.33", "1::8", "1:2:3:4:5:6:1.2.3.4", "0:0:0:0:0:0:0:0"]
    bad = [":", "1:2", "1:2:3:4:5:6:7:8:9", "::1::", "12345::", "g::", "::1.2.3", "1:2:3:4:5:6:7::8:9", "10.0.0.1", "", None, "1:::2", "::300.1.1.1"]
    got = {r.ip: r.b for r in spark.createDataFrame([(x,) for x in good + bad], "ip string").select("ip", net.ipv6_bytes(F.col("ip")).alias("b")).collect()}
    assert {x: bytes(got[x]) for x in good} == {x: ipaddress.ip_address(x).packed for x in good}
    assert {x: got[x] for x in bad} == dict.fromkeys(bad)


def test_files_of_one_name_and_ids_that_last(spark, tmp_path):
    root = str(tmp_path / "db")
    for d in "abc":
        (tmp_path / d).mkdir()
        (tmp_path / d / "eve.json").write_text("".join('{"timestamp": "2026-01-02T03:04:05Z", "event_type": "flow", "flow_id": %d}\n' % (ord(d) * 10 + k) for k in range(3)))
    assert pipeline.ingest(spark, [f"{tmp_path}/b/eve.json", f"{tmp_path}/c/eve.json"], root).first().new_rows == 6
    before = {r.flow_id: r.id for r in tables.scan(spark, root, "events").collect()}
    assert pipeline.ingest(spark, [f"{tmp_path}/a/eve.json", f"{tmp_path}/b/eve.json"], root).first().new_rows == 3
    after = {r.flow_id: (r.id, r.line_no) for r in tables.scan(spark, root, "events").collect()}
    assert len(after) == 9 == len({i for i, _ in after.values()}) and all(after[f][0] == i for f, i in before.items())
    assert sorted(n for _, n in after.values()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_id_lists_are_exact_and_rounding_is_binary(spark):
    x = spark.createDataFrame([("[9007199254740993, 7234567890123456789, 1.0, \"12\", \"x\", null, 1e3, -5]",), ("junk",), (None,)], "t string")
    assert [r.ids for r in x.select(values.json_ids(F.col("t")).alias("ids")).collect()] == [[9007199254740993, 7234567890123456789, 1, 12, 1000, -5], [], []]
    rng = np.random.default_rng(1)
    data = [k / 8 for k in range(80)] + [2.675, 1.005, 0.015, 99.995] + (rng.integers(0, 100_000, 2000) / 1000).tolist() + (np.arange(1, 2001) / 2000 * 100).tolist()
    got = spark.createDataFrame([(v,) for v in data], "v double").select("v", values.round2(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 2) for r in got)


def test_numbering_equals_one_sorted_list(spark):
    from tidewatch.operators.ranges import by_time, numbered

    r = np.random.default_rng(2)
    rows = [(int(a) * 400_000_000, f"10.0.{b}.1", k) for k, (a, b) in enumerate(zip(r.integers(-50, 4000, 500), r.integers(0, 30, 500), strict=True))]
    df = spark.createDataFrame(rows, "us long, ip string, k long")
    assert [x.k for x in by_time(df, "n", "us", [F.col("ip"), F.col("k")]).orderBy("n").collect()] == [x[2] for x in sorted(rows)]
    df = df.withColumn("w", F.col("k") % 2)
    got = numbered(df, "n", [F.col("ip")], F.left("ip", F.lit(4)), [F.col("k")], within=("w",)).collect()
    for w in (0, 1):
        assert [x.k for x in sorted((g for g in got if g.w == w), key=lambda g: g.n)] == [x[2] for x in sorted((x for x in rows if x[2] % 2 == w), key=lambda x: (x[1], x[2]))]
        assert sorted(g.n for g in got if g.w == w) == list(range(1, 251))


def test_filters_for_ipv6_and_in_batches(spark):
    s = spark.createDataFrame([("C", k, "::1" if k % 2 else "10.0.0.1", 1, "::2" if k % 2 else "10.0.0.2", None, 0, 1) for k in range(1, 60)], "case_id string, ord int, src_ip string, src_port int, dest_ip string, dest_port int, first_us long, last_us long").withColumn("proto", F.lit("TCP"))
    f = evidence.display_filter(s)
    assert {("ipv6.src == ::1" in r.filter, "(ip.src == 10.0.0.1" in r.filter) for r in f.collect()} == {(True, False), (False, True)}
    b = evidence.filter_batches(f, 1000).orderBy("batch").collect()
    assert [r.batch for r in b] == list(range(1, len(b) + 1)) and all(len(r.filter) <= 1000 for r in b) and len(b) > 5
    assert " || ".join(r.filter for r in b) == " || ".join(r.filter for r in f.orderBy("ord").collect())


def test_features_as_columns_and_runs_noted(spark, tmp_path):
    root = str(tmp_path / "db")
    rows = [event(i, i % 50, port=80 + i % 4) for i in range(30)] + [event(90, 9000)] + [event(50 + i, 30 + i, kind="anomaly") for i in range(3)]
    frame(spark, rows).withColumns({"source_file": F.lit("f"), "line_no": F.col("id")}).write.parquet(f"{root}/events")
    pipeline.analyse(spark, root, with_anomaly=True)
    found = tables.scan(spark, root, "findings").collect()
    assert all(r.description.startswith(r.source_ip) and '"episode_id"' in r.details for r in found)
    assert sorted(r.status for r in tables.scan(spark, root, "anomaly_runs").collect()) == ["finished", "started"]
    c = tables.scan(spark, root, "cases")
    w = prioritize.wide(pipeline.features(spark, root), c)
    assert w.count() == c.count() and w.columns[0] == "case_id"
    assert all(r.features["finding_count"] >= 1 for r in pipeline.prioritized(spark, root, trees=10, embed=True).collect())
