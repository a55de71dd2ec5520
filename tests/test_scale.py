"""Linear forms held against the plain ones they stand for."""

import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import correlation, dashboard, evidence, prioritize
from tidewatch.operators.ranges import accumulated
from tidewatch.sources import captures

FINDING = "ordinal long, finding_id string, rule_id string, source_ip string, start_us long, destination_ips array<string>, destination_ports array<int>, flow_ids array<long>"


def some_findings(seed, n, sources, span):
    r = np.random.default_rng(seed)
    few = lambda top, most: [int(x) for x in r.integers(0, top, r.integers(0, most))]
    rows = []
    for k in range(n):
        source = None if r.random() < 0.1 else f"s{r.integers(0, sources)}"
        rows.append((k, f"F-{k}", f"R0{r.integers(1, 4)}", source, int(r.integers(0, span)) * 1_000_000, [f"d{x}" for x in few(6, 3)], few(9, 3), [x for x in few(60, 3)]))
    return rows


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed, n, sources, span", [(1, 120, 3, 3000), (2, 120, 2, 20_000), (3, 80, 1, 200), (4, 150, 6, 9000), (5, 60, 2, 1)])
def test_links_give_the_cases_of_all_pairs(spark, seed, n, sources, span):
    rows = some_findings(seed, n, sources, span)
    f = spark.createDataFrame(rows, FINDING)
    pairs, links = correlation.relations(f, 100).collect(), correlation.links(f, 100).collect()
    roots = components(n, [(p.a, p.b) for p in pairs])
    assert components(n, [(p.a, p.b) for p in links]) == roots and len(set(roots)) < n

    def told(edges):
        got = defaultdict(lambda: (set(), set()))
        for e in edges:
            got[roots[e.a]][0].add(e.strength)
            got[roots[e.a]][1].update(e.reasons)
        return {k: (max(s), why) for k, (s, why) in got.items()}

    assert told(links) == told(pairs)


def test_links_of_one_flow_are_linear(spark):
    rows = [(k, f"F-{k}", f"R0{k % 3 + 1}", "s", k * 1_000_000, ["d"], [80], [7]) for k in range(300)]
    f = spark.createDataFrame(rows, FINDING)
    assert correlation.links(f, 1000).count() < 12 * 300 < correlation.relations(f, 1000).count()
    got = correlation.cases(f, correlation.links(f, 1000)).collect()
    assert [(r.finding_count, r.correlation_strength, len(r.correlation_reasons)) for r in got] == [(300, "Strong", 6)]
    assert correlation.links(f.limit(0)).count() == 0


def test_running_sums_over_ranges(spark):
    r = np.random.default_rng(1)
    rows = [(k, None if x > 90 else int(x), int(y)) for k, (x, y) in enumerate(zip(r.integers(0, 100, 400), r.integers(-5, 9, 400), strict=True))]
    df = spark.createDataFrame(rows, "k long, a int, y int")
    got = accumulated(df, [F.desc("a"), F.asc("k")], {"n": F.lit(1), "s": F.col("y")}).collect()
    order = sorted(rows, key=lambda x: (-1e9 if x[1] is None else x[1], -x[0]), reverse=True)
    assert {g.k: (g.n, g.s) for g in got} == {x[0]: (i + 1, sum(y for _, _, y in order[: i + 1])) for i, x in enumerate(order)}
    assert accumulated(df.limit(0), [F.asc("k")], {"n": F.lit(1)}).count() == 0


def plain_harvest(value, prefix, out):
    if isinstance(value, bool) or isinstance(value, (int, float)):
        if math.isfinite(float(value)):
            out.append((prefix, float(value)))
    elif isinstance(value, dict):
        for k, v in value.items():
            low = k.lower()
            if not (low.endswith(("_id", "_ids")) or "timestamp" in low or low in ("src_ip", "source_ip", "dest_ip", "destination_ip")):
                plain_harvest(v, f"{prefix}_{k}", out)
    elif isinstance(value, list):
        out.append((f"{prefix}_length", float(len(value))))
        if not (prefix.lower().endswith("_ids") or "flow_id" in prefix.lower() or "port" in prefix.lower()):
            for v in value:
                plain_harvest(v, prefix, out)


def test_harvest_walks_any_nesting(spark):
    docs = [
        {"total": 3, "rate": 0.25, "ok": True, "name": "x", "none": None, "big": 12345678901234567890, "neg": -1.5e300},
        {"flow_ids": [1, 2], "ports": [80, 443], "list": [1, [2, 3], {"a": 4}, "s", None, False], "empty": [], "Max_Timestamp": 5, "episode_id": 9, "Src_IP": 1},
        {"a": {"b": {"c": {"d": {"e": [1, {"f": [2]}]}}}}, "deep": {"port_count": 7, "flow_id": 3, "flow_id_list": [1]}},
        [1, 2, {"z": 3}], 7, "text", {},
    ]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(98, None), (99, "{not json")], "k long, details string")
    want = []
    for k, d in enumerate(docs):
        found = []
        plain_harvest(d, "details", found)
        want += [(k, *x) for x in found]
    assert sorted(tuple(r) for r in prioritize.harvested(df, ["k"], "details").collect()) == sorted(want)


def test_unknown_numbers_of_findings_become_features(spark):
    c = spark.createDataFrame([("CASE-1", ["F-1", "F-2"])], "case_id string, finding_ids array<string>").selectExpr("*", "0L first_us", "0L last_us", "array('s') source_ips", "array('d') destination_ips", "array('R01') rule_ids", "2L finding_count", "'Strong' correlation_strength", "array('Same source IP') correlation_reasons")
    f = spark.createDataFrame([("F-1", '{"score": {"inner": 2}, "total_flows": 5}'), ("F-2", '{"score": {"inner": 4.5}}')], "finding_id string, details string")
    f = f.selectExpr("*", "'R01' rule_id", "array(1L) event_ids", "array(1L) flow_ids", "array('d') destination_ips", "array(80) destination_ports", "array('') anomaly_types", "3L max_value", "5L total_flows", "null total_events")
    s = spark.createDataFrame([], "src_ip string, dest_ip string, proto string, first_us long, last_us long, flow_count long, event_count long, flow_ids array<long>, destination_ports array<int>, source_ports array<int>, duration_seconds long")
    got = {r.name: r.value for r in prioritize.case_features(c, f, s).collect()}
    assert (got["finding_details_score_inner_sum"], got["finding_details_score_inner_mean"], got["finding_details_score_inner_max"]) == (6.5, 3.25, 4.5)
    assert got["finding_details_total_flows_sum"] == 10 and len([n for n in got if "total_flows" in n]) == 3


def test_findings_that_share_many_flows_have_one_edge_a_pair(spark):
    flows = list(range(2000))
    rows = [(0, "F-0", "R01", "s", 0, ["d"], [80], flows), (1, "F-1", "R02", "t", 9_000_000_000, ["d", "e"], [443], flows), (2, "F-2", "R02", "u", 90_000_000_000, ["f"], [80], flows[::2]), (3, "F-3", "R01", "v", 0, None, None, [5000])]
    f = spark.createDataFrame(rows, FINDING)
    links = correlation.links(f, 100)
    assert links.count() < 20
    got = correlation.cases(f, links).orderBy("case_id").collect()
    assert [(r.finding_ids, r.destination_ips, r.correlation_strength) for r in got] == [(["F-0", "F-1", "F-2"], ["d", "e", "f"], "Strong"), (["F-3"], [], "Single")]
    assert got[0].correlation_reasons == sorted(["Shared flow", "Same destination IP", "Overlapping destination port", "Different detection rules"])


def test_pairs_do_not_carry_lists_of_flows(spark):
    rows = [(k, f"F-{k}", "R01", "s", k, ["d"], [80], [1, k + 10]) for k in range(6)]
    plan = correlation.relations(spark.createDataFrame(rows, FINDING), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "flow_ids" in line and "RDD" not in line]


def plain_matches(packets, selectors, pad):
    got = {}
    for number, us, *ends, proto in packets:
        for case, order, first, last, src, sport, dst, dport, named in selectors:
            for turn, (a, p, b, q) in enumerate([(src, sport, dst, dport), (dst, dport, src, sport)]):
                if (a, b) == (ends[0], ends[2]) and p in (None, ends[1]) and q in (None, ends[3]) and (named not in ("TCP", "UDP") or proto is None or named == proto) and first - pad <= us <= last + pad and not (turn and src == dst):
                    got[case, number] = min(got.get((case, number), (1 << 40, 0)), (order, turn))
    return {(c, n, ("forward", "reverse")[t]) for (c, n), (_, t) in got.items()}


def test_packets_meet_selectors_of_any_length(spark):
    r = np.random.default_rng(3)
    hour, far = 3_600_000_000, 2_000_000_000
    packets = [(k, int(r.integers(0, 3000 * hour)), *[("x", 1, "y", 2), ("y", 2, "x", 1), ("x", None, "y", 3), ("y", 4, "y", 4)][k % 4], (None, "TCP", "UDP")[k % 3]) for k in range(120)]
    selectors = []
    for k in range(400):
        first = int(r.integers(0, 3000 * hour))
        length = int(r.integers(0, (1, hour, 20 * hour, 400 * hour, 3000 * hour)[k % 5] + 1))
        selectors.append((f"C{k % 30}", k, first, first + length, *[("x", 1, "y", 2), ("y", 2, "x", 1), ("x", None, "y", None), ("y", 4, "y", None)][k % 7 % 4], ("TCP", None, "ICMP")[k % 3]))
    selectors.append(("LONG", 1, 0, 8_000_000_000_000_000_000, "x", 1, "y", 2, None))
    p = spark.createDataFrame(packets, "packet_number long, packet_us long, src_ip string, src_port int, dest_ip string, dest_port int, protocol string")
    s = spark.createDataFrame(selectors, "case_id string, ord int, first_us long, last_us long, src_ip string, src_port int, dest_ip string, dest_port int, proto string")
    got = evidence.packet_matches(p, s).select("case_id", "packet_number", "direction").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == plain_matches(packets, selectors, 2_000_000)
    free = evidence.packet_matches(p, s, timed=False).select("case_id", "packet_number", "direction").collect()
    assert {tuple(x) for x in free} == plain_matches(packets, selectors, far * hour)


def test_ids_of_a_case_are_rows(spark):
    f = spark.createDataFrame([("F-0", [1, 2], [7, 8]), ("F-1", [2, 3], [8]), ("F-2", None, [7])], "finding_id string, event_ids array<long>, flow_ids array<long>")
    c = spark.createDataFrame([("C", ["F-0", "F-1"]), ("D", ["F-2"])], "case_id string, finding_ids array<string>")
    e = spark.createDataFrame([(1, 7, "a"), (2, None, "b"), (3, 99, "c"), (4, 8, "d"), (5, 7, "e"), (6, 98, "f")], "id long, flow_id long, x string")
    assert sorted(tuple(r) for r in evidence.case_ids(c, f, "event_ids", "id").collect()) == [("C", 1), ("C", 2), ("C", 3)]
    got = [tuple(r) for r in evidence.case_events(c, f, e).select("case_id", "id", "x").collect()]
    assert sorted(got) == [("C", 1, "a"), ("C", 2, "b"), ("C", 3, "c"), ("C", 4, "d"), ("C", 5, "e"), ("D", 1, "a"), ("D", 5, "e")]
    got = [tuple(r) for r in dashboard.case_detail_events(c, f, e).select("case_id", "id").collect()]
    assert sorted(got) == [("C", 1), ("C", 2), ("C", 3), ("D", 1), ("D", 5)]


def test_sessions_meet_cases_of_any_length(spark):
    r = np.random.default_rng(5)
    hour = 3_600_000_000
    span = lambda k: (a := int(r.integers(0, 900 * hour)), a + int(r.integers(0, (1, hour, 30 * hour, 900 * hour)[k % 4] + 1)))
    case_rows = [(f"C{k}", *span(k), [f"s{k % 3}", "s9"], [["d0"], ["d0", "d1"], []][k % 3]) for k in range(40)] + [("LONG", 0, 8_000_000_000_000_000_000, ["s0"], ["d1"])]
    session_rows = [(f"S{k}", f"s{k % 4}", (None, "d0", "d1", "d2")[k % 5 % 4], *span(k + 1)) for k in range(80)] + [("T", "s1", "d0", 5 * hour, 4 * hour), ("U", "s0", "d1", 0, 8_000_000_000_000_000_000)]
    c = spark.createDataFrame(case_rows, "case_id string, first_us long, last_us long, source_ips array<string>, destination_ips array<string>")
    s = spark.createDataFrame(session_rows, "session_id string, src_ip string, dest_ip string, first_us long, last_us long")
    got = [(x.case_id, x.session_id) for x in prioritize.matching_sessions(c, s).collect()]
    want = [(a[0], b[0]) for a in case_rows for b in session_rows if b[1] in a[3] and b[3] <= a[2] and b[4] >= a[1] and (not a[4] or b[2] in a[4])]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_small_ranges_of_captures_share_tasks(spark):
    rows = spark.range(2000).selectExpr("'/c' as pcap_path", "cast(id as int) as range", "id * 16384 as begin", "(id + 1) * 16384 as stop")
    assert captures._spread(rows).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    large = rows.selectExpr("pcap_path", "range", "range * 33554432L as begin", "(range + 1) * 33554432L as stop")
    assert captures._spread(large).rdd.getNumPartitions() == 2000
    assert captures._spread(rows.limit(0)).collect() == []
