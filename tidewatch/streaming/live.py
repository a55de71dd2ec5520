"""The window and session aggregates over unbounded events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.anomaly import WINDOW_SECONDS
from ..operators.sessions import GAP_SECONDS


def live_windows(events: DataFrame, window_seconds: int = WINDOW_SECONDS, late: str = "10 minutes", alert: str = "alert") -> DataFrame:
    """Tumbling counts per source; a window is final once the watermark passes it.

    Distinct counts over a stream are approximate here, as exact ones would keep
    every value in state.
    """
    x = events.where("ts is not null and src_ip is not null").withWatermark("ts", late)
    return x.groupBy(F.window("ts", f"{window_seconds} seconds"), "src_ip").agg(
        F.count("*").alias("event_count"), F.approx_count_distinct(F.nullif("dest_ip", F.lit(""))).alias("unique_destinations"), F.approx_count_distinct("dest_port").alias("unique_destination_ports"),
        F.approx_count_distinct("flow_id").alias("unique_flows"), F.count_if(F.coalesce(F.col("event_type") == alert, F.lit(False))).alias("alert_count"),
    ).select("src_ip", F.unix_seconds("window.start").alias("epoch"), "event_count", "unique_destinations", "unique_destination_ports", "unique_flows", "alert_count")


def live_sessions(flows: DataFrame, gap_seconds: int = GAP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Sessions of (src_ip, dest_ip, proto); a flow keeps its session open for its length and the gap."""
    length = F.greatest(F.unix_seconds("flow_end") - F.unix_seconds("flow_start"), F.lit(0)) + gap_seconds
    x = flows.withWatermark("flow_start", late)
    return x.groupBy(F.session_window("flow_start", F.concat(length.cast("string"), F.lit(" seconds"))), "src_ip", "dest_ip", "proto").agg(F.count("*").alias("flow_count"), F.max("flow_end").alias("last_seen")).select(
        "src_ip", "dest_ip", "proto", F.col("session_window.start").alias("first_seen"), "last_seen", "flow_count")


def each_batch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a batch operator (rules, cases) on every micro-batch; state it needs is its own tables."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
