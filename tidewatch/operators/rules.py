"""The four detection rules, on one episode operator.

Input rows: id, us (microseconds), flow_id, src_ip, dest_ip, dest_port. Findings
share one schema; lists a rule does not carry are empty, and episodes have no
number until with_episode_ids() or all_findings() gives them one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import INTERNAL, inbound
from ..functions.values import epoch_iso, id_of
from ..sources.tables import stored
from .ranges import by_time, chained, counted, numbered


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    threshold: int
    seconds: int
    priority: str = "Medium"


R01 = Rule("R01", "High Connection Rate", 20, 60)
R02 = Rule("R02", "Multi-Port Activity", 3, 60)
R03 = Rule("R03", "Repeated Failed Authentication", 3, 10)
R04 = Rule("R04", "Repeated External Protocol Anomaly", 2, 60)
LISTS = ("event_ids", "flow_ids", "destination_ips", "destination_ports", "anomaly_types")
FINDING = ["rule_id", "rule_name", "priority", "source_ip", "start_us", "end_us", "episode_id", "max_value", "max_us", "total_flows", "total_events", *LISTS]


def first_of_flow(events: DataFrame) -> DataFrame:
    """The earliest row of each flow by (us, id), whatever its source; combined before the shuffle."""
    rest = [c for c in events.columns if c not in ("flow_id", "us", "id")]
    first = events.where("flow_id is not null").groupBy("flow_id").agg(F.min(F.struct("us", "id", *rest)).alias("r"))
    return first.select("flow_id", "r.*")


def episodes(rows: DataFrame, rule: Rule, distinct: str | None = None) -> DataFrame:
    """Member rows of each source's episodes, as ranges.chained() gives them."""
    return chained(rows, "src_ip", "us", rule.seconds * 1_000_000, rule.threshold, distinct)


def _sorted_set(c) -> Column:
    return F.array_sort(F.collect_set(c))


def _finding(rule: Rule, members: DataFrame, extra: dict[str, Column]) -> DataFrame:
    none = {"event_ids": "array<long>", "flow_ids": "array<long>", "destination_ips": "array<string>", "destination_ports": "array<int>", "anomaly_types": "array<string>"}
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("v"), "us")))
    got = members.groupBy("src_ip", "episode").agg(F.max(F.when(F.col("value").isNotNull(), F.col("window_end"))).alias("end_us"), top.alias("top"), *[c.alias(n) for n, c in extra.items()])
    columns = {
        "rule_id": F.lit(rule.rule_id), "rule_name": F.lit(rule.name), "priority": F.lit(rule.priority), "source_ip": F.col("src_ip"), "start_us": F.col("episode"), "episode_id": F.lit(None).cast("string"),
        "max_value": (-F.col("top.v")).cast("long"), "max_us": F.col("top.us"),
    }
    for n in ("total_flows", "total_events"):
        columns[n] = F.col(n).cast("long") if n in extra else F.lit(None).cast("long")
    for n, kind in none.items():
        columns[n] = F.col(n).cast(kind) if n in extra else F.array().cast(kind)
    return got.withColumns(columns).select(*FINDING)


def with_episode_ids(found: DataFrame) -> DataFrame:
    """Findings of any rules with their episodes numbered by source and start within each rule; found is stored on the way."""
    x = numbered(stored(found, "episodes"), "_number", [F.col("source_ip")], F.left("source_ip", F.lit(4)), [F.col("start_us")], within=("rule_id",))
    return x.withColumn("episode_id", F.concat("rule_id", id_of("", F.col("_number")))).select(*found.columns)


def high_connection_rate(events: DataFrame, rule: Rule = R01) -> DataFrame:
    flows = first_of_flow(events.where("flow_id is not null and src_ip is not null and us is not null").select("flow_id", "us", "id", "src_ip", "dest_ip"))
    members = episodes(flows, rule)
    return _finding(rule, members, {"flow_ids": F.array_sort(F.collect_list("flow_id")), "total_flows": F.count("*"), "destination_ips": _sorted_set("dest_ip")})


def multi_port(events: DataFrame, rule: Rule = R02, networks=INTERNAL) -> DataFrame:
    whole = events.where("flow_id is not null and src_ip is not null and us is not null and dest_ip is not null and dest_port is not null").where(inbound(F.col("src_ip"), F.col("dest_ip"), networks))
    flows = first_of_flow(whole.select("flow_id", "us", "id", "src_ip", "dest_ip", "dest_port"))
    members = episodes(flows, rule, "dest_port")
    return _finding(rule, members, {"flow_ids": F.array_sort(F.collect_list("flow_id")), "total_flows": F.count("*"), "destination_ips": _sorted_set("dest_ip"), "destination_ports": _sorted_set("dest_port")})


def login_failed(raw: Column, event_type: Column) -> Column:
    """An FTP reply, single or list, with the words of a failed login."""
    return (event_type == "ftp") & F.coalesce(F.get_json_object(raw, "$.ftp.reply").contains("Login incorrect"), F.lit(False))


def failed_authentication(events: DataFrame, failed: Column | None = None, rule: Rule = R03) -> DataFrame:
    """Only the first qualifying window of each source."""
    rows = events.where(login_failed(F.col("raw"), F.col("event_type")) if failed is None else failed).where("src_ip is not null and us is not null")
    rows = rows.select("id", "us", "flow_id", "src_ip", "dest_ip", "dest_port")
    width = rule.seconds * 1_000_000
    seen = counted(rows, "src_ip", "us", width)
    first = seen.where(F.col("value") >= rule.threshold).groupBy("src_ip").agg(F.min("us").alias("episode"))
    found = rows.join(first, "src_ip").where(F.col("us").between(F.col("episode"), F.col("episode") + width)).withColumns({"value": F.lit(1), "window_end": F.col("us")})
    out = _finding(rule, found, {"event_ids": F.transform(F.array_sort(F.collect_list(F.struct("us", "id"))), lambda s: s["id"]), "flow_ids": F.transform(F.array_sort(F.collect_list(F.when(F.col("flow_id").isNotNull(), F.struct("us", "id", "flow_id")))), lambda s: s["flow_id"]), "total_events": F.count("*"), "destination_ips": _sorted_set("dest_ip"), "destination_ports": _sorted_set("dest_port")})
    # the count is the number of attempts in the window
    return out.withColumns({"max_value": F.col("total_events"), "max_us": F.col("start_us")})


def protocol_anomaly(events: DataFrame, anomalous: Column | None = None, rule: Rule = R04, networks=INTERNAL) -> DataFrame:
    rows = events.where(F.col("event_type") == "anomaly" if anomalous is None else anomalous).where("src_ip is not null and dest_ip is not null and us is not null").where(inbound(F.col("src_ip"), F.col("dest_ip"), networks))
    kind = F.get_json_object("raw", "$.anomaly.event") if "raw" in events.columns else F.lit(None).cast("string")
    rows = rows.select("id", "us", "flow_id", "src_ip", "dest_ip", "dest_port", kind.alias("anomaly_type"))
    members = episodes(rows, rule)
    return _finding(rule, members, {"event_ids": _sorted_set("id"), "flow_ids": _sorted_set("flow_id"), "anomaly_types": _sorted_set(F.nullif(F.col("anomaly_type"), F.lit(""))), "destination_ips": _sorted_set("dest_ip"), "destination_ports": _sorted_set("dest_port"), "total_events": F.count_distinct("id"), "total_flows": F.count_distinct("flow_id")})


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """The rules' findings in order of time with a global number: finding_id, ordinal; their episodes are numbered anew."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return by_time(with_episode_ids(every), "ordinal", "start_us", [F.col("rule_id"), F.col("source_ip")]).withColumn("finding_id", id_of("", F.col("ordinal"))).withColumn("finding_id", F.concat("rule_id", "finding_id"))


#: The keys under which a rule's greatest count and its time are known.
COUNT_KEYS = {"R01": ("max_flow_count", "max_flow_timestamp"), "R02": ("max_port_count", "max_port_timestamp"), "R03": ("failed_attempts", None), "R04": ("max_anomaly_count", "max_anomaly_timestamp")}
UNITS = {"R01": "flows", "R02": "destination ports", "R03": "failed logins", "R04": "protocol anomalies"}


def described(found: DataFrame) -> DataFrame:
    """Findings with a description in words and details as JSON, by the keys of their rule; what a rule lacks is left out."""
    when = lambda c: epoch_iso(F.col(c) / 1_000_000)
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    details, words = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, (count, at) in COUNT_KEYS.items():
        begin, end = ("window_start", "window_end") if rule == "R03" else ("episode_start", "episode_end")
        fields = [F.col("episode_id"), when("start_us").alias(begin), when("end_us").alias(end), F.col("max_value").alias(count), *([when("max_us").alias(at)] if at else []), "total_flows", "total_events", *[full(c).alias(c) for c in ("destination_ips", "destination_ports", "anomaly_types")]]
        details = F.when(F.col("rule_id") == rule, F.to_json(F.struct(*fields))).otherwise(details)
        words = F.when(F.col("rule_id") == rule, F.concat("source_ip", F.lit(": up to "), F.col("max_value").cast("string"), F.lit(f" {UNITS[rule]} in a window, from "), when("start_us"), F.lit(" to "), when("end_us"))).otherwise(words)
    return found.withColumns({"description": words, "details": details})
