"""Flows from events and gap-based sessions from flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import id_of, whole_seconds
from ..sources.tables import stored
from .ranges import by_time, islands

GAP_SECONDS = 300


def flows(events: DataFrame) -> DataFrame:
    """One row per flow_id.

    Addresses, ports and protocol are each field's largest value over the flow's
    events, also when directions are mixed. Start and end are the largest stated
    ones, else the first and last event.
    """
    got = events.where("flow_id is not null").groupBy("flow_id").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("flow_start_us").alias("s"), F.max("flow_end_us").alias("e"),
        *[F.max(c).alias(c) for c in ("src_ip", "src_port", "dest_ip", "dest_port", "proto")], F.count("*").alias("event_count"),
    )
    return got.select("flow_id", F.coalesce("s", "first_us").alias("start_us"), F.coalesce("e", "last_us").alias("end_us"), "src_ip", "src_port", "dest_ip", "dest_port", "proto", "event_count").where("start_us is not null and end_us is not null")


def sessions(flow_rows: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Flows of one (src_ip, dest_ip, proto), each starting at most a gap after the latest end before it.

    Null is a key value like any other. Two levels of running maxima keep a hot
    key's flows in time buckets.
    """
    gap = gap_seconds * 1_000_000
    key = F.struct("src_ip", "dest_ip", "proto")
    rows = flow_rows.withColumn("key", key).withColumn("reach", F.greatest("end_us", "start_us") + gap)
    size = 64 * max(gap, 1_000_000)
    rows = _marked(rows, size)
    got = rows.groupBy("src_ip", "dest_ip", "proto", "session_start").agg(
        F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count("*").alias("flow_count"), F.sum("event_count").alias("event_count"),
        *[F.array_sort(F.collect_set(c)).alias(f"{n}_ports") for c, n in (("src_port", "source"), ("dest_port", "destination"))], F.array_sort(F.collect_list("flow_id")).alias("flow_ids"),
    )
    got = got.withColumn("duration_seconds", whole_seconds(F.col("first_us"), F.col("last_us"))).drop("session_start")
    got = by_time(stored(got, "sessions"), "_number", "first_us", [F.asc_nulls_first("src_ip"), F.asc_nulls_first("dest_ip"), F.asc_nulls_first("proto"), F.col("last_us")])
    return got.withColumn("session_id", id_of("SESSION", F.col("_number"), 5)).drop("_number")


def _marked(rows: DataFrame, size: int) -> DataFrame:
    return islands(rows, "key", "start_us", "reach", size, "session_start").drop("key", "reach")


def session_flows(session_rows: DataFrame) -> DataFrame:
    return session_rows.select("session_id", F.explode("flow_ids").alias("flow_id"))


def validation(flow_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """One row: flows, assigned, distinct, duplicates, missing, valid."""
    a = flow_rows.agg(F.count("*").alias("flows"))
    links = session_flows(session_rows).agg(F.count("*").alias("assigned"), F.count_distinct("flow_id").alias("distinct_assigned"))
    lost = flow_rows.join(session_flows(session_rows), "flow_id", "left_anti").agg(F.count("*").alias("missing"))
    one = a.join(links, F.lit(True)).join(lost, F.lit(True))  # one row each
    return one.withColumn("duplicates", F.col("assigned") - F.col("distinct_assigned")).withColumn("valid", (F.col("duplicates") == 0) & (F.col("missing") == 0))


def statistics(session_rows: DataFrame) -> DataFrame:
    return session_rows.agg(
        F.count("*").alias("sessions"), F.sum("flow_count").alias("flows"), F.max("flow_count").alias("largest"), F.avg("flow_count").alias("average"), F.max("duration_seconds").alias("longest"), F.count_if(F.size("destination_ports") > 1).alias("multi_port"),
    )


def largest(session_rows: DataFrame, n: int = 10) -> DataFrame:
    return session_rows.orderBy(F.desc("flow_count"), "session_id").limit(n)
