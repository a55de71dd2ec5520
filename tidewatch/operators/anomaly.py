"""Tumbling windows per source, robust baselines, scores and links to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import anomaly_id, epoch_iso, modified_z, scale_of, window_floor

METRICS = ("event_count", "unique_destinations", "unique_destination_ports", "unique_flows", "alert_count")
DETECTOR, METHOD, STATUS = "robust_window_detector", "modified_z_score_mad", "candidate_for_investigation"
THRESHOLD, WINDOW_SECONDS, MIN_WINDOWS = 3.5, 60, 5


def check(window_seconds: int, threshold: float, min_windows: int) -> None:
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    if min_windows < 2:
        raise ValueError("min_windows must be 2 or more")


def windows(events: DataFrame, window_seconds: int = WINDOW_SECONDS, alert: str = "alert") -> DataFrame:
    """Five counts for each (src_ip, window); blank destinations do not count."""
    x = events.where("us is not null and src_ip is not null").withColumn("epoch", window_floor(F.col("us"), window_seconds))
    got = x.groupBy("src_ip", "epoch").agg(
        F.count("*").alias("event_count"), F.count_distinct(F.nullif("dest_ip", F.lit(""))).alias("unique_destinations"), F.count_distinct("dest_port").alias("unique_destination_ports"),
        F.count_distinct("flow_id").alias("unique_flows"), F.count_if(F.coalesce(F.col("event_type") == alert, F.lit(False))).alias("alert_count"),
    )
    return got.withColumns({"window_start": epoch_iso(F.col("epoch")), "window_end": epoch_iso(F.col("epoch") + window_seconds), "window_seconds": F.lit(window_seconds)})


def long_form(window_rows: DataFrame) -> DataFrame:
    return window_rows.unpivot(["src_ip", "epoch", "window_start", "window_end"], list(METRICS), "metric", "observed").withColumn("observed", F.col("observed").cast("double"))


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median and MAD of observed by keys, exact, from counts per value, so equal values are combined before any shuffle."""
    def median(x: DataFrame, value: str, name: str) -> DataFrame:
        counts = x.groupBy(*keys, value).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value))
        total = F.sum("n").over(Window.partitionBy(*keys))
        mid = counts.withColumns({"upto": upto, "total": total}).where("upto - n < floor(total / 2) + 1 and upto >= floor((total + 1) / 2)")
        # the middle position, or the two around the middle
        low, high = F.min(F.when(F.expr("upto >= floor((total + 1) / 2)"), F.col(value))), F.max(F.when(F.expr("upto - n < floor(total / 2) + 1"), F.col(value)))
        return mid.groupBy(*keys).agg(((low + high) / 2).alias(name), F.max("total").alias("sample_count"))

    counts = rows.groupBy(*keys, "observed").agg(F.count("*").alias("n"))
    mid = median(counts, "observed", "median_value")
    away = counts.join(mid, keys).withColumn("away", F.abs(F.col("observed") - F.col("median_value")))
    return mid.join(median(away, "away", "mad_value").drop("sample_count"), keys)


def baselines(window_rows: DataFrame, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """scope, src_ip (null for global), metric, median_value, mad_value, sample_count."""
    rows = long_form(window_rows)
    names = ["scope", "src_ip", "metric", "median_value", "mad_value", "sample_count"]
    whole = _spread(rows, ["metric"]).withColumns({"scope": F.lit("global"), "src_ip": F.lit(None).cast("string")}).select(*names)
    enough = rows.groupBy("src_ip", "metric").agg(F.count("*").alias("n")).where(F.col("n") >= min_windows).select("src_ip", "metric")
    own = _spread(rows.join(enough, ["src_ip", "metric"], "left_semi"), ["src_ip", "metric"]).withColumn("scope", F.lit("source")).select(*names)
    return whole.unionByName(own)


def findings(window_rows: DataFrame, baseline_rows: DataFrame, window_seconds: int = WINDOW_SECONDS, threshold: float = THRESHOLD) -> DataFrame:
    """Windows whose one-sided modified z-score reaches the threshold, against the source's baseline or else the global one."""
    whole = baseline_rows.where("scope = 'global'").select("metric", F.col("median_value").alias("g_median"), F.col("mad_value").alias("g_mad"))
    own = baseline_rows.where("scope = 'source'").select("src_ip", "metric", F.col("median_value").alias("s_median"), F.col("mad_value").alias("s_mad"))
    x = long_form(window_rows).join(F.broadcast(whole), "metric").join(own, ["src_ip", "metric"], "left")  # the global side has a row per metric
    x = x.withColumns({"baseline_median": F.coalesce("s_median", "g_median"), "baseline_mad": F.coalesce("s_mad", "g_mad"), "baseline_scope": F.when(F.col("s_median").isNotNull(), "source").otherwise("global")})
    x = x.withColumn("scale_used", scale_of(F.col("baseline_mad"), F.col("g_mad"), F.col("baseline_median")))
    x = x.withColumn("anomaly_score", modified_z(F.col("observed"), F.col("baseline_median"), F.col("scale_used"))).where(F.col("anomaly_score") >= threshold)
    return x.select(
        anomaly_id(DETECTOR, F.col("src_ip"), F.col("window_start"), window_seconds, F.col("metric")).alias("finding_id"), F.lit(DETECTOR).alias("detector_name"), F.lit(METHOD).alias("method"), F.lit(window_seconds).alias("window_seconds"),
        "epoch", "window_start", "window_end", "src_ip", "metric", F.col("observed").alias("observed_value"), "baseline_median", "baseline_mad", "scale_used", "anomaly_score", F.lit(threshold).alias("threshold"), "baseline_scope", F.lit(STATUS).alias("status"),
    )


def linked_events(events: DataFrame, finding_rows: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(finding_id, event_id) of events in a finding's window."""
    x = events.where("us is not null and src_ip is not null").select(F.col("id").alias("event_id"), "src_ip", window_floor(F.col("us"), window_seconds).alias("epoch"))
    return x.join(finding_rows.select("finding_id", "src_ip", "epoch"), ["src_ip", "epoch"]).select("finding_id", "event_id").distinct()


def event_counts(finding_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Findings with the number of their events; those without keep 0."""
    return finding_rows.join(links, "finding_id", "left").groupBy("finding_id", "src_ip", "metric", "anomaly_score").agg(F.count("event_id").alias("linked"))


def top(finding_rows: DataFrame, n: int = 10) -> DataFrame:
    return finding_rows.orderBy(F.desc("anomaly_score"), "finding_id").limit(n)
