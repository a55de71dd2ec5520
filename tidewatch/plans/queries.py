"""Registered queries of the engine's operators and the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import community_id, is_internal
from ..functions import values
from ..functions.values import json_ids
from ..operators import anomaly, correlation, dashboard, evidence, prioritize, rules, sessions
from ..sources import adapter, ndjson, pcap
from ..sources.tables import shared_folder, stored
from . import packets, pipeline

HOURS = 6
WIDE = pipeline.Settings(window_seconds=86400, threshold=1.5).wide(HOURS * 3600)
US = HOURS * 3_600_000_000
EXPORTED = ("source_ip", "start_us", "end_us", "max_value", "max_us", "total_flows", "total_events", "event_ids", "flow_ids", "destination_ips", "destination_ports")


def alert():
    return F.col("event_type") == "alert"


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, as comparators want them."""
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def ev(spark, sf_dir):
    return adapter.events(spark, sf_dir)


def findings_df(spark, sf_dir):
    return pipeline.detect(ev(spark, sf_dir), WIDE, alert(), alert())


def stored_findings(spark, sf_dir):
    return stored(findings_df(spark, sf_dir), "findings")


def cases_df(found):
    return correlation.cases(found, correlation.links(found, WIDE.case_seconds))


def r01_high_connection_rate(spark, sf_dir):
    return flat(rules.with_episode_ids(rules.high_connection_rate(ev(spark, sf_dir), WIDE.r01)).select("episode_id", *EXPORTED))


def r02_multi_port(spark, sf_dir):
    return flat(rules.with_episode_ids(rules.multi_port(ev(spark, sf_dir), WIDE.r02)).select("episode_id", *EXPORTED))


def r03_failed_authentication(spark, sf_dir):
    return flat(rules.with_episode_ids(rules.failed_authentication(ev(spark, sf_dir), alert(), WIDE.r03)).select("episode_id", *EXPORTED))


def r04_protocol_anomaly(spark, sf_dir):
    return flat(rules.with_episode_ids(rules.protocol_anomaly(ev(spark, sf_dir), alert(), WIDE.r04)).select("episode_id", *EXPORTED))


def findings(spark, sf_dir):
    return flat(findings_df(spark, sf_dir).select("ordinal", "finding_id", "rule_id", *EXPORTED))


def flows(spark, sf_dir):
    return sessions.flows(ev(spark, sf_dir))


SESSION_COLUMNS = ("session_id", "src_ip", "dest_ip", "proto", "first_us", "last_us", "flow_count", "event_count", "source_ports", "destination_ports", "flow_ids", "duration_seconds")
GAP = 6 * 3600


def sessions_df(spark, sf_dir):
    return sessions.sessions(sessions.flows(ev(spark, sf_dir)), GAP).select(*SESSION_COLUMNS)


def sessions_of_flows(spark, sf_dir):
    return flat(sessions_df(spark, sf_dir))


def session_validation(spark, sf_dir):
    f = sessions.flows(ev(spark, sf_dir))
    return sessions.validation(f, sessions.sessions(f, GAP))


def session_statistics(spark, sf_dir):
    return sessions.statistics(sessions_df(spark, sf_dir)).withColumn("average", F.round("average", 6))


def top_sessions(spark, sf_dir):
    return sessions.largest(sessions_df(spark, sf_dir)).select("session_id", "flow_count")


def finding_relations(spark, sf_dir):
    return flat(correlation.relations(stored_findings(spark, sf_dir), WIDE.case_seconds).select("finding_a", "finding_b", "strength", "reasons"))


CASE_COLUMNS = ("case_id", "first_us", "last_us", "source_ips", "destination_ips", "finding_ids", "rule_ids", "finding_count", "correlation_strength", "correlation_reasons")


def cases(spark, sf_dir):
    return flat(cases_df(stored_findings(spark, sf_dir)).select(*CASE_COLUMNS))


def case_evaluation(spark, sf_dir):
    return correlation.evaluation(cases_df(stored_findings(spark, sf_dir)))


def anomaly_parts(spark, sf_dir):
    w = anomaly.windows(ev(spark, sf_dir), WIDE.window_seconds)
    b = anomaly.baselines(w, WIDE.min_windows)
    return w, b, anomaly.findings(w, b, WIDE.window_seconds, WIDE.threshold)


def anomaly_windows(spark, sf_dir):
    return anomaly_parts(spark, sf_dir)[0].select("src_ip", "window_start", "window_end", *anomaly.METRICS)


def anomaly_baselines(spark, sf_dir):
    return anomaly_parts(spark, sf_dir)[1]


ANOMALY_COLUMNS = ("finding_id", "src_ip", "window_start", "metric", "observed_value", "baseline_median", "baseline_mad", "scale_used", "baseline_scope")


def anomaly_findings(spark, sf_dir):
    return anomaly_parts(spark, sf_dir)[2].select(*ANOMALY_COLUMNS, F.round("anomaly_score", 6).alias("score"))


def anomaly_events(spark, sf_dir):
    return anomaly.linked_events(ev(spark, sf_dir), anomaly_parts(spark, sf_dir)[2], WIDE.window_seconds)


def anomaly_event_counts(spark, sf_dir):
    f = anomaly_parts(spark, sf_dir)[2]
    return anomaly.event_counts(f, anomaly.linked_events(ev(spark, sf_dir), f, WIDE.window_seconds)).select("finding_id", "src_ip", "metric", "linked")


def top_anomalies(spark, sf_dir):
    return anomaly.top(anomaly_parts(spark, sf_dir)[2]).select("finding_id", F.round("anomaly_score", 6).alias("score"))


def case_events(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    return evidence.case_events(cases_df(found), found, ev(spark, sf_dir)).select("case_id", "id")


def selectors_df(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    return evidence.selectors(evidence.case_events(cases_df(found), found, ev(spark, sf_dir)))


def case_selectors(spark, sf_dir):
    return selectors_df(spark, sf_dir)


def packets_df(spark, sf_dir):
    """Every event as a packet, odd ones turned round, a second later."""
    odd = F.col("id") % 2 == 1
    turn = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a)).alias(a)
    return ev(spark, sf_dir).select(F.lit("capture").alias("pcap_path"), F.col("id").alias("packet_number"), (F.col("us") + 1_000_000).alias("packet_us"), turn("src_ip", "dest_ip"), turn("src_port", "dest_port"), turn("dest_ip", "src_ip"), turn("dest_port", "src_port"), F.when(F.col("id") % 4 < 2, "TCP").when(F.col("id") % 4 == 2, "udp").alias("protocol"))


def packet_matches(spark, sf_dir):
    return evidence.packet_matches(packets_df(spark, sf_dir), selectors_df(spark, sf_dir)).select("case_id", "packet_number", "direction")


def packet_directions(spark, sf_dir):
    return evidence.packet_matches(packets_df(spark, sf_dir), selectors_df(spark, sf_dir), timed=False).select("case_id", "packet_number", "direction")


def captures_df(spark, sf_dir):
    """A capture named by each even day with orders."""
    o = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("d")).distinct().where(F.dayofmonth("d") % 2 == 0)
    return o.select(F.concat(F.lit("/captures/eth0-"), F.date_format("d", "yyyy-MM-dd"), F.lit(".pcap")).alias("pcap_path"))


def capture_assignment(spark, sf_dir):
    return evidence.capture_assignment(cases_df(stored_findings(spark, sf_dir)), captures_df(spark, sf_dir)).groupBy("case_id").agg(F.count("pcap_path").alias("captures"), F.min("pcap_path").alias("first_capture"))


def case_sessions(spark, sf_dir):
    return prioritize.matching_sessions(cases_df(stored_findings(spark, sf_dir)), sessions_df(spark, sf_dir)).select("case_id", "session_id")


def finding_number_features(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    x = prioritize.finding_numbers(found).groupBy("rule_id").agg(*[f(n).alias(f"{n}_{s}") for n in ("details_total_flows", "details_failed_attempts", "details_max_port_count") for f, s in ((F.sum, "sum"), (F.max, "max"))], F.sum("event_ids_length").alias("event_ids_length_sum"))
    return x


def features_and_cases(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    c = stored(cases_df(found), "cases")
    return prioritize.case_features(c, found, sessions_df(spark, sf_dir)), c


def case_features(spark, sf_dir):
    return features_and_cases(spark, sf_dir)[0].withColumn("value", F.round("value", 9))


def case_priorities(spark, sf_dir):
    f, c = features_and_cases(spark, sf_dir)
    return prioritize.ranked(c, prioritize.scores(stored(f, "features"), c)).select("case_id", "priority_rank", "priority_score", "priority_level", "isolation_forest_score", "isolation_forest_classification")


def percentile_scores(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("isolation_forest_score"))
    return prioritize.percentiles(p).select("p_partkey", "priority_score")


def priority_ranks(spark, sf_dir):
    """Parts as cases whose scores are given, with many ties."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    case_rows = p.select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("case_id"), (F.col("p_partkey") % 100).alias("first_us"))
    given = p.select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("case_id"), (F.col("p_size") / 60.0).alias("isolation_forest_score"))
    return prioritize.ranked(case_rows, given).select("case_id", "priority_score", "priority_level", "isolation_forest_classification", "priority_rank")


def nested_numbers(spark, sf_dir):
    """Numbers of nested details, made of events."""
    e = ev(spark, sf_dir)
    inner = F.struct((F.col("id") % 7).alias("b"), F.col("us").alias("timestamp_us"), F.array(F.col("dest_port"), F.col("src_port")).alias("ports"))
    details = F.to_json(F.struct(inner.alias("a"), F.array(F.col("id") % 3, F.col("dest_port")).alias("list"), F.col("id").alias("episode_id"), (F.col("id") % 2 == 0).alias("even"), F.col("proto")))
    return prioritize.harvested(e.select("id", details.alias("details")), ["id"], "details")


def daily_counts(spark, sf_dir):
    return dashboard.daily_counts(ev(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def type_histogram(spark, sf_dir):
    return dashboard.type_histogram(ev(spark, sf_dir))


def suspicious_events(spark, sf_dir):
    return dashboard.suspicious_events(findings_df(spark, sf_dir))


def filtered_events(spark, sf_dir):
    return dashboard.filtered(ev(spark, sf_dir), event_type="click", proto="UDP", dest_ip="All").select("id")


def source_options(spark, sf_dir):
    return dashboard.options(ev(spark, sf_dir), "src_ip")


def last_day(spark, sf_dir):
    return dashboard.timeframe(ev(spark, sf_dir), hours=24).select("id", "us")


SEARCHED = ("id", "event_type", "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "alert_sid", "alert_signature")


def event_search(spark, sf_dir):
    return dashboard.search(ev(spark, sf_dir), "FTP|10\\.0\\.1[0-9]\\.", SEARCHED).select("id")


def alert_events(spark, sf_dir):
    return dashboard.filtered(dashboard.alerts(ev(spark, sf_dir)), proto="TCP").select("id", "alert_sid", "alert_signature")


def event_page(spark, sf_dir):
    return dashboard.page(ev(spark, sf_dir), 3, ["us", "id"]).select("id")


def evidence_rows(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    return dashboard.evidence_rows(cases_df(found), found, ev(spark, sf_dir)).select("case_id", "finding_id", "event_id", "src_ip", "us")


def case_detail_events(spark, sf_dir):
    found = stored_findings(spark, sf_dir)
    return dashboard.case_detail_events(cases_df(found), found, ev(spark, sf_dir)).select("case_id", "id").distinct()


def internal_addresses(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.select("src_ip").distinct().select("src_ip", is_internal(F.col("src_ip")).alias("internal"))


def community_ids(spark, sf_dir):
    return ev(spark, sf_dir).select("id", community_id(F.col("src_ip"), F.col("src_port"), F.col("dest_ip"), F.col("dest_port"), F.col("proto")).alias("community_id"))


def lines_df(spark, sf_dir):
    """The events as log lines; some blank, some cut short, some of a type that is left out."""
    e = ev(spark, sf_dir)
    kind = F.when(F.col("id") % 11 == 3, "stats").otherwise(F.col("event_type")).alias("event_type")
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    of = lambda ok, **fields: F.when(ok, F.struct(*[v.alias(k) for k, v in fields.items()]))
    alerted, k = F.col("alert_sid").isNotNull(), F.col("dest_port")
    whole = F.to_json(F.struct(
        stamp("us").alias("timestamp"), kind, "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto",
        of(F.lit(True), start=stamp("flow_start_us"), end=stamp("flow_end_us")).alias("flow"), of(F.col("app_proto") == "http", http_method=F.lit("GET"), url=F.concat(F.lit("/p/"), k.cast("string"))).alias("http"),
        of(k % 5 == 0, client=F.struct(F.concat(F.lit("ssh-"), k.cast("string")).alias("software_version"))).alias("ssh"), of(alerted, signature_id=F.col("alert_sid"), signature=F.col("alert_signature"), severity=k % 3 + 1).alias("alert"),
    ))
    raw = F.when(F.col("id") % 13 == 5, "  ").when(F.col("id") % 17 == 4, F.substring(whole, 1, 40)).otherwise(whole)
    return e.select(F.lit("events.json").alias("source_file"), (F.col("id") + 1).alias("line_no"), raw.alias("raw"))


def ingest_summary(spark, sf_dir):
    return ndjson.summary(ndjson.classified(lines_df(spark, sf_dir)))


def ingested_events(spark, sf_dir):
    return ndjson.events_of(ndjson.classified(lines_df(spark, sf_dir))).select(*INGESTED)


INGESTED = ("id", "line_no", "event_type", "us", "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto", "flow_start_us", "flow_end_us", "ssh_client_software", "http_method", "http_url", "alert_sid", "alert_signature", "alert_severity", "community_id")


def read_lines(spark, sf_dir):
    """The log lines as two files of one name in different folders, written and read back with line numbers."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, name in enumerate("ab"):
        lines_df(spark, sf_dir).where(F.col("line_no") % 2 == k).orderBy("line_no").coalesce(1).select("raw").write.text(f"{folder}/{name}")
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/{name}")) if s.getPath().getName().startswith("part-"))
        fs.rename(part, path(f"{folder}/{name}/eve.json"))
    got = ndjson.events_of(ndjson.classified(ndjson.numbered_lines(spark, [f"{folder}/a/eve.json", f"{folder}/b/eve.json"])))
    return got.select("id", "line_no", "flow_id", "us", "dest_ip")


def failed_logins(spark, sf_dir):
    """R03 on log lines: replies as text and as lists, and others that say something else."""
    reply = F.when(F.col("id") % 16 == 3, '"230 Login OK"').when(F.col("id") % 2 == 0, '"530 Login incorrect."').otherwise('["530 no", "Login incorrect"]')
    e = ev(spark, sf_dir).withColumns({"event_type": F.when(F.col("event_type") == "alert", "ftp").otherwise("flow"), "raw": F.concat(F.lit('{"ftp": {"reply": '), reply, F.lit("}}"))})
    return flat(rules.with_episode_ids(rules.failed_authentication(e, rule=WIDE.r03)).select("episode_id", *EXPORTED))


def anomaly_type_events(spark, sf_dir):
    """R04 on events of type anomaly, with kinds from the log line."""
    kind = F.concat(F.lit('{"anomaly": {"event": "kind'), (F.col("id") % 3).cast("string"), F.lit('"}}'))
    e = ev(spark, sf_dir).withColumns({"event_type": F.when(F.col("event_type") == "alert", "anomaly").otherwise("flow"), "raw": kind})
    return flat(rules.with_episode_ids(rules.protocol_anomaly(e, rule=WIDE.r04)).select("episode_id", "anomaly_types", *EXPORTED))


def finding_details(spark, sf_dir):
    """Findings in words and the details of their rules."""
    x = rules.described(findings_df(spark, sf_dir))
    of = lambda k: F.get_json_object("details", f"$.{k}")
    return x.select("finding_id", "description", F.coalesce(*[of(k) for k, _ in rules.COUNT_KEYS.values()]).cast("long").alias("greatest"), F.coalesce(of("episode_start"), of("window_start")).alias("begins"), of("total_flows").cast("long").alias("total_flows"))


def alert_search(spark, sf_dir):
    return dashboard.search(dashboard.alerts(ev(spark, sf_dir)), "port 1[0-9]|\\.7$").select("id")


def case_page(spark, sf_dir):
    """Cases of one strength in order of time, the first 25."""
    c = dashboard.filter_cases(cases_df(stored_findings(spark, sf_dir)), correlation_strength="Strong", finding_count="All")
    return c.orderBy("first_us", "case_id").limit(25).select("case_id", "first_us", "finding_count")


def display_values(spark, sf_dir):
    """What pages show of an event, and the values features are made of."""
    e = dashboard.with_missing(ev(spark, sf_dir), {"app_proto": "application", "sensor": "probe"})
    text = F.concat(F.lit(" Shared Flow-"), F.col("proto"), F.lit("/x "))
    return e.select(
        "id", values.or_na(F.col("application")).alias("application"), values.or_na(F.col("probe")).alias("probe"), values.or_na(F.when(F.col("id") % 2 == 0, F.col("src_port"))).alias("port"), values.display_time(F.timestamp_micros("us")).alias("shown"),
        values.safe_name(text).alias("name"), values.priority_level((F.col("id") % 101).cast("double")).alias("level"), values.or_null(F.when(F.col("id") % 3 == 0, "  ").otherwise(text)).alias("trimmed"),
        values.int_or_null(F.when(F.col("id") % 3 == 1, F.concat(F.lit(" "), F.col("src_port").cast("string"), F.lit(" "))).otherwise("x1")).alias("number"), F.round(F.sin(values.hour_angle(F.col("us"))), 9).alias("sine"),
    )


def one_year(spark, sf_dir):
    e = ev(spark, sf_dir)
    return dashboard.timeframe(e, year=2024).select("id")


def case_links(spark, sf_dir):
    """Links to findings of which every tenth is lost, and cases that hold the first two findings of the first case with two."""
    found = stored_findings(spark, sf_dir)
    c = stored(cases_df(found), "cases")
    lost = correlation.missing_findings(c, found.where("ordinal % 10 <> 0")).select(F.lit("lost").alias("what"), F.col("finding_id").alias("value"))
    ids = c.where("finding_count > 1").orderBy("case_id").select(F.slice("finding_ids", 1, 2).alias("two")).first().two
    return lost.unionByName(correlation.co_membership(c, ids).select(F.lit("holds").alias("what"), F.col("case_id").alias("value")))


def case_filters(spark, sf_dir):
    f = evidence.display_filter(selectors_df(spark, sf_dir))
    return f.select("case_id", "ord", "filter")


def merged_packets(spark, sf_dir):
    """Two overlapping reads of one capture."""
    p = packets_df(spark, sf_dir)
    return evidence.merge_packets([p.where("packet_number % 3 <> 0"), p.where("packet_number % 2 = 0")]).select("packet_number", "packet_us")


def field_export(spark, sf_dir):
    """Packets as tab-separated text, written and read back."""
    path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex[:12]}"
    tcp = F.col("proto") == "TCP"
    x = ev(spark, sf_dir).select("id", ((F.col("us") / 1_000_000).cast("decimal(20,6)")).cast("string").alias("t"), "src_ip", F.lit("").alias("s6"), "dest_ip", F.lit("").alias("d6"), *[F.when(ok, F.col(c).cast("string")).otherwise("") for c in ("src_port", "dest_port") for ok in (tcp, ~tcp)], "proto", F.lit(" 7 "), F.when(F.col("id") % 2 == 0, "60").otherwise("x"))
    x.select(F.concat_ws("\t", *[F.col(f"`{c}`") if isinstance(c, str) else c for c in x.columns])).write.text(path)
    return pcap.read_tsv(spark, path).select("packet_number", "packet_us", "src_ip", "src_port", "dest_ip", "dest_port", "protocol", "tcp_stream", "frame_length", "http_method", "is_retransmission")


def decoded_ids(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.select("id", F.array_join(json_ids(F.concat(F.lit("["), F.col("flow_id").cast("string"), F.lit(".0, "), F.col("id").cast("string"), F.lit("]"))), ",").alias("ids"))


QUERIES = [
    r01_high_connection_rate, r02_multi_port, r03_failed_authentication, r04_protocol_anomaly, findings, flows, sessions_of_flows, session_validation, session_statistics, top_sessions, finding_relations, cases, case_evaluation,
    anomaly_windows, anomaly_baselines, anomaly_findings, anomaly_events, anomaly_event_counts, top_anomalies, case_events, case_selectors, packet_matches, packet_directions, capture_assignment, case_sessions, finding_number_features,
    case_features, case_priorities, percentile_scores, priority_ranks, nested_numbers, daily_counts, type_histogram, suspicious_events, filtered_events, source_options, last_day, event_search, alert_events, event_page, evidence_rows, case_detail_events,
    internal_addresses, community_ids, ingest_summary, ingested_events, decoded_ids,
    read_lines, failed_logins, anomaly_type_events, finding_details, alert_search, case_page, display_values, one_year, case_links, case_filters, merged_packets, field_export,
]


def queries():
    return {f.__name__: f for f in [*QUERIES, *packets.QUERIES]}


# --- SQL -----------------------------------------------------------------------------------------

FORWARD = f"(partition by src_ip order by us range between current row and {US} following)"
EXTERNAL = "src_ip not like '192.168.0.%' and dest_ip like '192.168.0.%'"


def _text(c: str) -> str:
    return f"array_to_string({c}, ',')"


def _rule(rule, rows: str, metric: str, lists: dict[str, str], p: str) -> str:
    """CTEs that end in {p}: one row per episode with lists."""
    empty = {"event_ids": "[]::bigint[]", "flow_ids": "[]::bigint[]", "destination_ips": "[]::varchar[]", "destination_ports": "[]::int[]", "total_flows": "null::bigint", "total_events": "null::bigint", "anomaly_types": "[]::varchar[]"}
    cols = ", ".join(f"{lists.get(n, e)} as {n}" for n, e in empty.items())
    t = rule.threshold
    return f"""{p}_b as ({rows}),
{p}_w as (select *, {metric} over {FORWARD} as value, max(us) over {FORWARD} as window_end from {p}_b),
{p}_h as (select distinct src_ip, us, window_end from {p}_w where value >= {t}),
{p}_l as (select *, lag(window_end) over (partition by src_ip order by us) as before from {p}_h),
{p}_i as (select *, sum(case when before is null or us > before then 1 else 0 end) over (partition by src_ip order by us) as isl from {p}_l),
{p}_e as (select src_ip, isl, min(us) as episode, max(window_end) as end_us from {p}_i group by all),
{p}_m as (select w.*, e.episode, e.end_us from {p}_w w join {p}_e e on w.src_ip = e.src_ip and w.us between e.episode and e.end_us),
{p} as (select '{rule.rule_id}' as rule_id, src_ip as source_ip, episode as start_us, end_us, max(case when value >= {t} then value end) as max_value,
  min(us) filter (value = (select max(x.value) from {p}_m x where x.src_ip = m.src_ip and x.episode = m.episode)) as max_us, {cols} from {p}_m m group by src_ip, episode, end_us)"""


FIRST = "(select *, row_number() over (partition by flow_id order by us, id) as n from ev {where})"
IPS, PORTS, FLOWS = "list_sort(list(distinct dest_ip))", "list_sort(list(distinct dest_port))", "list_sort(list(flow_id))"
W_R01 = _rule(WIDE.r01, "select * from " + FIRST.format(where="") + " where n = 1", "count(*)", {"flow_ids": FLOWS, "total_flows": "count(*)", "destination_ips": IPS}, "r01")
W_R02 = _rule(WIDE.r02, "select * from " + FIRST.format(where="where " + EXTERNAL) + " where n = 1", "count(distinct dest_port)", {"flow_ids": FLOWS, "total_flows": "count(*)", "destination_ips": IPS, "destination_ports": PORTS}, "r02")
W_R03 = f"""r03_w as (select *, count(*) over {FORWARD} as value from ev where event_type = 'alert'),
r03_f as (select src_ip, min(us) as episode from r03_w where value >= {WIDE.r03.threshold} group by 1),
r03_m as (select w.*, f.episode from r03_w w join r03_f f on w.src_ip = f.src_ip and w.us between f.episode and f.episode + {US}),
r03 as (select 'R03' as rule_id, src_ip as source_ip, episode as start_us, max(us) as end_us, count(*) as max_value, episode as max_us, list(id order by us, id) as event_ids, list(flow_id order by us, id) as flow_ids,
  {IPS} as destination_ips, {PORTS} as destination_ports, null::bigint as total_flows, count(*) as total_events from r03_m group by src_ip, episode)"""
R04_LISTS = {"event_ids": "list_sort(list(distinct id))", "flow_ids": "list_sort(list(distinct flow_id))", "destination_ips": IPS, "destination_ports": PORTS, "total_events": "count(distinct id)", "total_flows": "count(distinct flow_id)"}
W_R04 = _rule(WIDE.r04, f"select * from ev where event_type = 'alert' and {EXTERNAL}", "count(*)", R04_LISTS, "r04")
W_R04K = _rule(WIDE.r04, f"select * from ev where event_type = 'alert' and {EXTERNAL}", "count(*)", R04_LISTS | {"anomaly_types": "list_sort(list(distinct 'kind' || (id % 3)))"}, "r04")
LIST_COLUMNS = ("event_ids", "flow_ids", "destination_ips", "destination_ports")
OUT = ", ".join(f"{_text(c)} as {c}" if c in LIST_COLUMNS else c for c in EXPORTED)
W_EV = f"ev as ({adapter.SQL})"
FIELDS = ", ".join(("rule_id", *EXPORTED))
W_FINDINGS = ",\n".join([W_EV, W_R01, W_R02, W_R03, W_R04, f"""allf as (select {FIELDS} from r01 union all select {FIELDS} from r02 union all select {FIELDS} from r03 union all select {FIELDS} from r04),
f as (select *, row_number() over (order by start_us, rule_id, source_ip) as ordinal from allf),
fi as (select *, rule_id || '-' || lpad(ordinal::varchar, greatest(4, length(ordinal::varchar))::int, '0') as finding_id from f)"""])
NUMBERED = "{p} || '-' || lpad(n::varchar, greatest({w}, length(n::varchar))::int, '0')"
W_RELATIONS = W_FINDINGS + f""",
pr as (select a.finding_id as finding_a, b.finding_id as finding_b, a.ordinal as a, b.ordinal as b, list_has_any(a.flow_ids, b.flow_ids) as p_flow, a.source_ip = b.source_ip as p_source, abs(a.start_us - b.start_us) <= {US} as p_time,
  list_has_any(a.destination_ips, b.destination_ips) as p_dest, list_has_any(a.destination_ports, b.destination_ports) as p_port, a.rule_id <> b.rule_id as p_rule
  from fi a join fi b on a.ordinal < b.ordinal),
rel as (select *, case when p_flow or p_source and p_dest and p_time then 'Strong' when p_source and p_time and (p_port or p_rule) then 'Moderate' end as strength,
  list_filter([case when p_flow then 'Shared flow' end, case when p_source then 'Same source IP' end, case when p_time then 'Within 5-minute window' end, case when p_dest then 'Same destination IP' end,
    case when p_port then 'Overlapping destination port' end, case when p_rule then 'Different detection rules' end], lambda x: x is not null) as reasons from pr)"""
W_CASES = "recursive " + W_RELATIONS + """,
edge as (select a, b from rel where strength is not null union select b, a from rel where strength is not null),
reach as (select ordinal as a, ordinal as b from fi union select r.a, e.b from reach r join edge e on r.b = e.a),
root as (select a as ordinal, min(b) as root from reach group by 1),
grp as (select root, min(start_us) as first_us, max(start_us) as last_us, list_sort(list(distinct source_ip)) as source_ips, list_sort(list_distinct(flatten(list(destination_ips)))) as destination_ips,
  list(finding_id order by ordinal) as finding_ids, list_sort(list(distinct rule_id)) as rule_ids, count(*) as finding_count from fi join root using (ordinal) group by root),
lnk as (select root, max(strength) as strength, list_sort(list_distinct(flatten(list(reasons)))) as reasons from rel join root on rel.a = root.ordinal where strength is not null group by root),
cs as (select 'CASE-' || lpad(n::varchar, greatest(4, length(n::varchar))::int, '0') as case_id, * from (
  select grp.*, coalesce(strength, 'Single') as correlation_strength, coalesce(reasons, []) as correlation_reasons, row_number() over (order by first_us, root) as n from grp left join lnk using (root)))"""
W_FLOWS = W_EV + """,
fl as (select flow_id, coalesce(max(flow_start_us), min(us)) as start_us, coalesce(max(flow_end_us), max(us)) as end_us, max(src_ip) as src_ip, max(src_port) as src_port, max(dest_ip) as dest_ip, max(dest_port) as dest_port, max(proto) as proto, count(*) as event_count
  from ev group by flow_id)"""
W_SESSIONS = W_FLOWS + f""",
sm as (select *, max(greatest(end_us, start_us)) over (partition by src_ip, dest_ip, proto order by start_us range between unbounded preceding and 1 preceding) as before from fl),
si as (select *, sum(case when before is null or start_us > before + {GAP * 1_000_000} then 1 else 0 end) over (partition by src_ip, dest_ip, proto order by start_us) as isl from sm),
sg as (select src_ip, dest_ip, proto, min(start_us) as first_us, max(end_us) as last_us, count(*) as flow_count, sum(event_count)::bigint as event_count, list_sort(list(distinct src_port)) as source_ports, list_sort(list(distinct dest_port)) as destination_ports, list_sort(list(flow_id)) as flow_ids
  from si group by src_ip, dest_ip, proto, isl),
ss as (select *, greatest(0, (last_us - first_us) // 1000000)::bigint as duration_seconds, 'SESSION-' || lpad(row_number() over (order by first_us, src_ip, dest_ip, proto, last_us)::varchar, 5, '0') as session_id from sg)"""
DAY = WIDE.window_seconds
W_WINDOWS = W_EV + f""",
aw as (select src_ip, (us // 1000000) // {DAY} * {DAY} as epoch, count(*) as event_count, count(distinct nullif(dest_ip, '')) as unique_destinations, count(distinct dest_port) as unique_destination_ports, count(distinct flow_id) as unique_flows, count(*) filter (event_type = 'alert') as alert_count
  from ev group by all),
al as (""" + " union all ".join(f"select src_ip, epoch, '{m}' as metric, {m}::double as observed from aw" for m in anomaly.METRICS) + f"""),
gm as (select metric, median(observed) as m, count(*) as n from al group by 1),
gb as (select metric, any_value(m) as median_value, median(abs(observed - m)) as mad_value, any_value(n) as sample_count from al join gm using (metric) group by 1),
sm as (select src_ip, metric, median(observed) as m, count(*) as n from al group by all having count(*) >= {WIDE.min_windows}),
sb as (select src_ip, metric, any_value(m) as median_value, median(abs(observed - m)) as mad_value, any_value(n) as sample_count from al join sm using (src_ip, metric) group by all),
an as (select src_ip, epoch, metric, observed, coalesce(sb.median_value, gb.median_value) as med, coalesce(sb.mad_value, gb.mad_value) as mad, gb.mad_value as g_mad, case when sb.median_value is null then 'global' else 'source' end as scope
  from al join gb using (metric) left join sb using (src_ip, metric)),
sc as (select *, case when mad > 0 then mad when g_mad > 0 then g_mad else greatest(1.0, abs(med) * 0.1) end as scale_used, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as window_start from an),
af as (select *, 'ANOM-' || upper(substr(sha1('{anomaly.DETECTOR}|' || src_ip || '|' || window_start || '|{DAY}|' || metric), 1, 12)) as finding_id, case when observed <= med then 0.0::double else 0.6745::double * (observed - med) / scale_used end as score from sc),
ag as (select * from af where score >= {WIDE.threshold}),
ae as (select distinct finding_id, id as event_id from ag join ev on ev.src_ip = ag.src_ip and (ev.us // 1000000) // {DAY} * {DAY} = ag.epoch)"""
W_CASE_IDS = W_CASES + """,
cf as (select case_id, unnest(finding_ids) as finding_id from cs),
ci as (select distinct case_id, unnest(event_ids) as id from cf join fi using (finding_id)),
cw as (select distinct case_id, unnest(flow_ids) as flow_id from cf join fi using (finding_id)),
ce as (select case_id, ev.* from ci join ev using (id) union select case_id, ev.* from (select case_id, flow_id as f from cw) x join ev on ev.flow_id = x.f),
sl as (select *, row_number() over (partition by case_id order by first_us, src_ip, dest_ip, coalesce(src_port, -1), coalesce(dest_port, -1), proto nulls first) as ord from (
  select case_id, src_ip, src_port, dest_ip, dest_port, proto, min(us) as first_us, max(us) as last_us from ce group by all)),
ori as (select case_id, ord, first_us, last_us, proto, src_ip as s1, src_port as p1, dest_ip as s2, dest_port as p2, 'forward' as direction from sl union all
  select case_id, ord, first_us, last_us, proto, dest_ip, dest_port, src_ip, src_port, 'reverse' from sl where src_ip <> dest_ip),
pk as (select id as packet_number, us + 1000000 as packet_us, case when id % 2 = 1 then dest_ip else src_ip end as src_ip, case when id % 2 = 1 then dest_port else src_port end as src_port,
  case when id % 2 = 1 then src_ip else dest_ip end as dest_ip, case when id % 2 = 1 then src_port else dest_port end as dest_port, case when id % 4 < 2 then 'TCP' when id % 4 = 2 then 'UDP' end as protocol from ev),
pm as (select case_id, packet_number, ord, direction, packet_us between first_us - 2000000 and last_us + 2000000 as timed from pk join ori on src_ip = s1 and dest_ip = s2 and (p1 is null or p1 = src_port) and (p2 is null or p2 = dest_port) and (protocol is null or protocol = proto))"""


W_CASE_SESSIONS = W_CASES + ",\n" + W_SESSIONS[len(W_EV) + 2 :] + """,
met as (select case_id, ss.* from cs join ss on list_contains(source_ips, src_ip) and ss.first_us <= cs.last_us and ss.last_us >= cs.first_us and (len(cs.destination_ips) = 0 or list_contains(cs.destination_ips, dest_ip)))"""


def _distinct(c: str) -> str:
    return f"len(list_distinct(flatten(list({c}))))"


def _features_sql() -> str:
    """case_features: one select per group of names, each a list of (name, value) pairs."""
    angle = lambda c: f"({c} // 1000000) % 86400 * (2 * pi() / 86400)"
    rule = lambda c, *r: f"case when rule_id in ({', '.join(map(repr, r))}) then {c} end"
    numbers = {
        "event_ids_length": "len(event_ids)", "session_ids_length": "0", "details_max_flow_count": rule("max_value", "R01"), "details_total_flows": rule("total_flows", "R01", "R02", "R04"), "details_destination_ips_length": "len(destination_ips)",
        "details_max_port_count": rule("max_value", "R02"), "details_destination_ports_length": rule("len(destination_ports)", "R02", "R03", "R04"), "details_failed_attempts": rule("max_value", "R03"), "details_max_anomaly_count": rule("max_value", "R04"),
        "details_anomaly_types_length": rule("0", "R04"), "details_total_events": rule("total_events", "R04"),
    }
    groups = {
        "cs": {
            "finding_count": "finding_count", "source_ip_count": "len(source_ips)", "destination_ip_count": "len(destination_ips)", "unique_rule_count": "len(rule_ids)", "case_duration_seconds": "greatest(0, last_us - first_us) / 1e6::double",
            "correlation_reason_count": "len(correlation_reasons)", **{f"case_{e}_hour_{f}": f"{f}({angle(c)})" for e, c in (("start", "first_us"), ("end", "last_us")) for f in ("sin", "cos")},
        },
        "cf join fi using (finding_id) group by case_id": {
            "finding_destination_ip_count": _distinct("destination_ips"), "unique_flow_id_count": _distinct("flow_ids"), "unique_destination_port_count": _distinct("destination_ports"), "findings_with_flow_ids": "count(*) filter (len(flow_ids) > 0)",
            "findings_with_destination_ports": "count(*) filter (len(destination_ports) > 0)", **{f"finding_{n}_{s}": f"{f}({e})" for n, e in numbers.items() for s, f in (("sum", "sum"), ("mean", "avg"), ("max", "max"))},
        },
        "met group by case_id": {
            "matched_session_count": "count(*)", "session_total_flow_count": "sum(flow_count)", "session_total_event_count": "sum(event_count)", "session_unique_flow_id_count": _distinct("flow_ids"), "session_unique_destination_port_count": _distinct("destination_ports"),
            "session_unique_source_port_count": _distinct("source_ports"), "session_unique_protocol_count": "count(distinct proto)", "session_duration_total_seconds": "sum(duration_seconds)", "session_duration_mean_seconds": "avg(duration_seconds)", "session_duration_max_seconds": "max(duration_seconds)",
        },
    }
    wide = [f"select case_id, unnest([{', '.join(f'{{name: {n!r}, value: ({v})::double}}' for n, v in values.items())}]) as p from {source}" for source, values in groups.items()]
    counted = {"correlation_strength": "select case_id, correlation_strength as v from cs", "rule": "select case_id, rule_id as v from cf join fi using (finding_id)", "correlation_reason": "select case_id, unnest(correlation_reasons) as v from cs", "session_protocol": "select case_id, proto as v from met"}
    counts = [f"select case_id, '{p}_' || regexp_replace(lower(trim(v)), '[ /-]', '_', 'g') || '_count' as name, count(*)::double as value from ({q}) where v is not null group by all" for p, q in counted.items()]
    return _with(W_CASE_SESSIONS + ", cf as (select case_id, unnest(finding_ids) as finding_id from cs)", f"select case_id, name, round(value, 9) as value from (select case_id, p.name as name, p.value as value from ({' union all '.join(wide)}) union all {' union all '.join(counts)}) where value is not null")


def _with(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


def _episode_sql(ctes: str, name: str) -> str:
    return _with(f"{W_EV},\n{ctes}", f"select '{name.upper()}-' || lpad(row_number() over (order by source_ip, start_us)::varchar, 4, '0') as episode_id, {OUT} from {name}")


def _match(where: str) -> str:
    return _with(W_CASE_IDS, f"select case_id, packet_number, arg_min(direction, ord * 2 + case direction when 'reverse' then 1 else 0 end) as direction from pm {where} group by case_id, packet_number")


ISO = "strftime(make_timestamp({} // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"
HEX4 = "lpad(hex({}), 4, '0')"
IP_HEX = "array_to_string(list_transform(string_split({}, '.'), lambda x: lpad(hex(x::bigint), 2, '0')), '')"


def _community(columns: str, source: str) -> str:
    a, b = IP_HEX.format("src_ip"), IP_HEX.format("dest_ip")
    return f"""select {columns}, '1:' || base64(unhex(sha1(unhex('0000' || case when first then a || b else b || a end || case proto when 'TCP' then '06' when 'UDP' then '11' end || '00' || case when first then p || q else q || p end)))) as community_id
from (select *, a < b or a = b and src_port <= dest_port as first from (select *, {a} as a, {b} as b, {HEX4.format('src_port::bigint')} as p, {HEX4.format('dest_port::bigint')} as q from {source}))"""


STATUS = "case when id % 13 = 5 then 'blank' when id % 17 = 4 then 'malformed' when id % 11 = 3 then 'skipped' else 'event' end"


PERCENTILES = """with v as (select p_partkey, p_size, (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double) / count(*) over () * 100.0::double as x from part),
e as (select *, x * 100.0::double as p, x * 134217729.0::double - (x * 134217729.0::double - x) as h from v)"""
PERCENTILE = """case when p - floor(p) = 0.5 then floor(p) + case when (h * 100.0::double - p) + (x - h) * 100.0::double > 0 or (h * 100.0::double - p) + (x - h) * 100.0::double = 0 and floor(p) % 2 = 1 then 1.0::double else 0.0::double end
  else round_even(p, 0) end / 100.0::double"""


def oracle_sql() -> dict[str, str]:
    return {
        "r01_high_connection_rate": _episode_sql(W_R01, "r01"), "r02_multi_port": _episode_sql(W_R02, "r02"), "r03_failed_authentication": _episode_sql(W_R03, "r03"), "r04_protocol_anomaly": _episode_sql(W_R04, "r04"),
        "findings": _with(W_FINDINGS, f"select ordinal, finding_id, rule_id, {OUT} from fi"),
        "flows": _with(W_FLOWS, "select * from fl"),
        "sessions_of_flows": _with(W_SESSIONS, "select " + ", ".join(f"{_text(c)} as {c}" if c in ("source_ports", "destination_ports", "flow_ids") else c for c in SESSION_COLUMNS) + " from ss"),
        "session_validation": _with(W_SESSIONS, "select (select count(*) from fl) as flows, (select count(*) from (select unnest(flow_ids) from ss)) as assigned, (select count(distinct f) from (select unnest(flow_ids) as f from ss)) as distinct_assigned, 0::bigint as missing, 0::bigint as duplicates, true as valid"),
        "session_statistics": _with(W_SESSIONS, "select count(*) as sessions, sum(flow_count)::bigint as flows, max(flow_count) as largest, round(avg(flow_count), 6) as average, max(duration_seconds) as longest, count(*) filter (len(destination_ports) > 1) as multi_port from ss"),
        "top_sessions": _with(W_SESSIONS, "select session_id, flow_count from ss order by flow_count desc, session_id limit 10"),
        "finding_relations": _with(W_RELATIONS, f"select finding_a, finding_b, strength, {_text('reasons')} as reasons from rel where strength is not null"),
        "cases": _with(W_CASES, "select " + ", ".join(f"{_text(c)} as {c}" if c in ("source_ips", "destination_ips", "finding_ids", "rule_ids", "correlation_reasons") else c for c in CASE_COLUMNS) + " from cs"),
        "case_evaluation": _with(W_CASES, "select 'findings' as dimension, finding_count::varchar as value, count(*) as cases from cs group by all union all select 'strength', correlation_strength, count(*) from cs group by all union all select 'reason', r, count(*) from (select unnest(correlation_reasons) as r from cs) group by all"),
        "anomaly_windows": _with(W_WINDOWS, f"select src_ip, strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as window_start, strftime(make_timestamp((epoch + {DAY}) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as window_end, {', '.join(anomaly.METRICS)} from aw"),
        "anomaly_baselines": _with(W_WINDOWS, "select 'global' as scope, null::varchar as src_ip, metric, median_value, mad_value, sample_count from gb union all select 'source', src_ip, metric, median_value, mad_value, sample_count from sb"),
        "anomaly_findings": _with(W_WINDOWS, "select finding_id, src_ip, window_start, metric, observed as observed_value, med as baseline_median, mad as baseline_mad, scale_used, scope as baseline_scope, round(score, 6) as score from ag"),
        "anomaly_events": _with(W_WINDOWS, "select finding_id, event_id from ae"),
        "anomaly_event_counts": _with(W_WINDOWS, "select finding_id, src_ip, metric, count(event_id) as linked from ag left join ae using (finding_id) group by all"),
        "top_anomalies": _with(W_WINDOWS, "select finding_id, round(score, 6) as score from ag order by ag.score desc, finding_id limit 10"),
        "case_events": _with(W_CASE_IDS, "select case_id, id from ce"),
        "case_selectors": _with(W_CASE_IDS, "select case_id, src_ip, src_port, dest_ip, dest_port, proto, first_us, last_us, ord::int as ord from sl"),
        "packet_matches": _match("where timed"), "packet_directions": _match(""),
        "capture_assignment": _with(W_CASES + """,
cap as (select distinct ts::date as d, '/captures/eth0-' || strftime(ts::date, '%Y-%m-%d') || '.pcap' as path from events where day(ts) % 2 = 0),
hit as (select case_id, path from cs join cap on make_timestamp(first_us)::date = d),
asg as (select case_id, path from cs left join hit using (case_id))""", "select case_id, count(path) as captures, min(path) as first_capture from asg group by 1"),
        "case_sessions": _with(W_CASES + ",\n" + W_SESSIONS[len(W_EV) + 2 :], "select case_id, session_id from cs join ss on list_contains(source_ips, src_ip) and ss.first_us <= cs.last_us and ss.last_us >= cs.first_us and (len(cs.destination_ips) = 0 or list_contains(cs.destination_ips, dest_ip))"),
        "finding_number_features": _with(W_FINDINGS, "select rule_id, " + ", ".join(f"{f}(case when rule_id in ({r}) then {c} end)::double as {n}_{f}" for n, c, r in (("details_total_flows", "total_flows", "'R01', 'R02', 'R04'"), ("details_failed_attempts", "max_value", "'R03'"), ("details_max_port_count", "max_value", "'R02'")) for f in ("sum", "max")) + ", sum(len(event_ids))::double as event_ids_length_sum from fi group by 1"),
        "case_features": _features_sql(),
        "percentile_scores": PERCENTILES + "\nselect p_partkey, " + PERCENTILE + " as priority_score from e",
        "priority_ranks": PERCENTILES + """,
ps as (select p_partkey, p_size, """ + PERCENTILE + """ as score from e)
select 'P-' || p_partkey as case_id, score as priority_score, case when score < 33 then 'Low' when score < 66 then 'Medium' else 'High' end as priority_level, case when p_size / 60.0::double > 0.5 then 'Anomaly' else 'Normal' end as isolation_forest_classification,
  row_number() over (order by score desc, p_size desc, p_partkey % 100, 'P-' || p_partkey) as priority_rank from ps""",
        "nested_numbers": _with(W_EV, """select id, 'details_a_b' as name, (id % 7)::double as value from ev union all select id, 'details_a_ports_length', 2 from ev union all select id, 'details_list_length', 2 from ev
  union all select id, 'details_list', (id % 3)::double from ev union all select id, 'details_list', dest_port::double from ev union all select id, 'details_even', case when id % 2 = 0 then 1 else 0 end from ev"""),
        "daily_counts": _with(W_EV, "select strftime(make_timestamp(us)::date, '%Y-%m-%d') as day, count(*) as events from ev group by 1"),
        "type_histogram": _with(W_EV, "select event_type, count(*) as events from ev group by 1"),
        "suspicious_events": _with(W_FINDINGS, "select count(distinct i) as suspicious from (select unnest(event_ids) as i from fi)"),
        "filtered_events": _with(W_EV, "select id from ev where event_type = 'click' and proto = 'UDP'"),
        "source_options": _with(W_EV, "select distinct src_ip as option from ev"),
        "last_day": _with(W_EV, "select id, us from ev where us >= (select max(us) from ev) - 86400000000"),
        "event_search": _with(W_EV, r"select id from ev where " + " or ".join(rf"coalesce(regexp_matches(lower({c}::varchar), 'ftp|10\.0\.1[0-9]\.'), false)" for c in SEARCHED)),
        "alert_events": _with(W_EV, "select id, alert_sid, alert_signature from ev where alert_sid is not null and proto = 'TCP'"),
        "event_page": _with(W_EV, "select id from ev order by us, id limit 8 offset 16"),
        "evidence_rows": _with(W_CASE_IDS, "select case_id, finding_id, id as event_id, src_ip, us from (select case_id, finding_id, unnest(event_ids) as id from cf join fi using (finding_id)) join ev using (id)"),
        "case_detail_events": _with(W_CASE_IDS, "select distinct case_id, id from ci join ev using (id) union select case_id, ev.id from (select case_id, flow_id as f from cw where case_id not in (select case_id from ci join ev using (id))) x join ev on ev.flow_id = x.f"),
        "internal_addresses": _with(W_EV, "select distinct src_ip, src_ip like '192.168.0.%' as internal from ev"),
        "community_ids": _with(W_EV, _community("id", "ev")),
        "ingest_summary": _with(W_EV, f"select {STATUS} as status, case when {STATUS} in ('event', 'skipped') then case when id % 11 = 3 then 'stats' else event_type end end as event_type, count(*) as lines from ev group by all"),
        "ingested_events": _with(W_EV, _community("68719476736 + id + 1 as id, id + 1 as line_no, event_type, us, flow_id, src_ip, src_port, dest_ip, dest_port, proto, app_proto, flow_start_us, flow_end_us, case when dest_port % 5 = 0 then 'ssh-' || dest_port end as ssh_client_software, "
            "case app_proto when 'http' then 'GET' end as http_method, case app_proto when 'http' then '/p/' || dest_port end as http_url, alert_sid, alert_signature, case when alert_sid is not null then dest_port % 3 + 1 end as alert_severity", f"(select * from ev where {STATUS} = 'event')")),
        "read_lines": _with(W_EV, f"select (case when (id + 1) % 2 = 0 then 1 else 2 end)::bigint * 68719476736 + n as id, n as line_no, flow_id, us, dest_ip from (select *, row_number() over (partition by (id + 1) % 2 order by id) as n from ev) where {STATUS} = 'event'"),
        "failed_logins": _episode_sql(W_R03.replace("event_type = 'alert'", "event_type = 'alert' and id % 16 <> 3"), "r03"),
        "anomaly_type_events": _episode_sql(W_R04K, "r04").replace("as episode_id,", "as episode_id, array_to_string(anomaly_types, ',') as anomaly_types,"),
        "finding_details": _with(W_FINDINGS, f"select finding_id, source_ip || ': up to ' || max_value || case rule_id " + " ".join(f"when '{k}' then ' {v}'" for k, v in rules.UNITS.items()) + f" end || ' in a window, from ' || {ISO.format('start_us')} || ' to ' || {ISO.format('end_us')} as description, max_value as greatest, {ISO.format('start_us')} as begins, total_flows from fi"),
        "alert_search": _with(W_EV, "select id from ev where alert_sid is not null and (" + " or ".join(rf"coalesce(regexp_matches(lower({c}::varchar), 'port 1[0-9]|\.7$'), false)" for c in ("us", "flow_start_us", "flow_end_us", *adapter.COLUMNS)) + ")"),
        "case_page": _with(W_CASES, "select case_id, first_us, finding_count from cs where correlation_strength = 'Strong' order by first_us, case_id limit 25"),
        "display_values": _with(W_EV, """select id, coalesce(app_proto, 'N/A') as application, 'N/A' as probe, case when id % 2 = 0 then src_port::varchar else 'N/A' end as port, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S UTC') as shown,
  'shared_flow_' || lower(proto) || '_x' as name, case when id % 101 < 33 then 'Low' when id % 101 < 66 then 'Medium' else 'High' end as level, case when id % 3 <> 0 then 'Shared Flow-' || proto || '/x' end as trimmed, case when id % 3 = 1 then src_port end as number,
  round(sin((us // 1000000) % 86400 * (2 * pi() / 86400)), 9) as sine from ev"""),
        "one_year": _with(W_EV, "select id from ev where year(make_timestamp(us)) = 2024"),
        "case_links": _with(W_CASES, "select 'lost' as what, finding_id as value from (select unnest(finding_ids) as finding_id from cs) join fi using (finding_id) where ordinal % 10 = 0 union all select 'holds', case_id from cs where list_has_all(finding_ids, (select finding_ids[1:2] from cs where finding_count > 1 order by case_id limit 1))"),
        "case_filters": _with(W_CASE_IDS, "select case_id, ord::int as ord, lower(proto) || ' && (' || " + " || ' || ' || ".join(f"'(ip.src == ' || {a}_ip || ' && ip.dst == ' || {b}_ip || coalesce(' && ' || lower(proto) || '.srcport == ' || {a}_port, '') || coalesce(' && ' || lower(proto) || '.dstport == ' || {b}_port, '') || ')'" for a, b in (("src", "dest"), ("dest", "src")))
            + " || ')' || ' && frame.time_epoch >= ' || ((first_us - 2000000)::decimal(20, 0) / 1000000)::decimal(20, 6) || ' && frame.time_epoch <= ' || ((last_us + 2000000)::decimal(20, 0) / 1000000)::decimal(20, 6) as filter from sl"),
        "merged_packets": _with(W_CASE_IDS, "select packet_number, packet_us from pk where packet_number % 3 <> 0 or packet_number % 2 = 0"),
        "field_export": _with(W_EV, "select id as packet_number, us as packet_us, src_ip, src_port, dest_ip, dest_port, proto as protocol, 7::bigint as tcp_stream, case when id % 2 = 0 then 60::bigint end as frame_length, null::varchar as http_method, false as is_retransmission from ev"),
        "decoded_ids": _with(W_EV, "select id, flow_id::varchar || ',' || id::varchar as ids from ev"),
        **packets.oracle_sql(),
    }
