"""Case features, Isolation Forest scores and the ranking of cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import hour_angle, priority_level, round2, safe_name
from ..sources.tables import stored
from .evidence import case_ids
from .ranges import accumulated, bucket_of, in_buckets

TREES, SUBSAMPLE, TRAINING_CASES, SEED = 300, 256, 50_000, 42
#: Numeric keys of findings that become sum, mean and max features.
FINDING_NUMBERS = ("event_ids_length", "session_ids_length", "details_max_flow_count", "details_total_flows", "details_destination_ips_length", "details_max_port_count", "details_destination_ports_length", "details_failed_attempts", "details_max_anomaly_count", "details_anomaly_types_length", "details_total_events")


def matching_sessions(case_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """(case_id, session columns): same source, overlapping time, and destination among the case's unless it has none."""
    # either the session begins within the case's time or the case within the session's: sources and buckets as long as the longer one are the key
    c = case_rows.select("case_id", F.explode("source_ips").alias("c_src"), F.col("first_us").alias("c_first"), F.col("last_us").alias("c_last"), (F.size("destination_ips") == 0).alias("c_any"))
    s = session_rows.withColumn("_after", F.col("first_us") + 1)
    level = lambda points, at, ranges: points.join(F.broadcast(ranges.select("_level").distinct()), how="cross").withColumn("_bucket", bucket_of(F.col(at), F.col("_level")))  # noqa: E731  as many as lengths
    cases, own = in_buckets(c, "c_first", "c_last"), in_buckets(s, "_after", "last_us")
    met = lambda x, y: x.join(y, ["_level", "_bucket"]).where(F.col("src_ip") == F.col("c_src"))
    begun = met(level(s, "first_us", cases), cases).where("first_us between c_first and c_last and last_us >= c_first")
    open_ = met(own, level(c, "c_first", own)).where("c_first between _after and last_us")
    columns = ["case_id", "c_any", *session_rows.columns]
    x = begun.select(*columns).unionByName(open_.select(*columns))
    named = case_rows.select(F.col("case_id").alias("_case"), F.explode(F.array_distinct("destination_ips")).alias("_dest"))
    x = x.join(named, (F.col("case_id") == F.col("_case")) & (F.col("dest_ip") == F.col("_dest")), "left")
    return x.where("c_any or _dest is not null").select("case_id", *session_rows.columns)


def _distinct(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(case_id, name): how many different values a case's lists hold."""
    return rows.select("case_id", F.explode(column).alias("v")).where("v is not null").distinct().groupBy("case_id").agg(F.count("*").cast("double").alias(name))


def finding_numbers(findings: DataFrame) -> DataFrame:
    """The numeric keys a finding of each rule has; null where it lacks one."""
    rule = lambda *r: F.col("rule_id").isin(*r)
    has = lambda c, *r: F.when(rule(*r), c.cast("double"))
    size = lambda c: F.size(c)
    return findings.withColumns({
        "event_ids_length": size("event_ids").cast("double"), "session_ids_length": F.lit(0.0), "details_max_flow_count": has(F.col("max_value"), "R01"), "details_total_flows": has(F.col("total_flows"), "R01", "R02", "R04"),
        "details_destination_ips_length": size("destination_ips").cast("double"), "details_max_port_count": has(F.col("max_value"), "R02"), "details_destination_ports_length": has(size("destination_ports"), "R02", "R03", "R04"),
        "details_failed_attempts": has(F.col("max_value"), "R03"), "details_max_anomaly_count": has(F.col("max_value"), "R04"), "details_anomaly_types_length": has(size("anomaly_types"), "R04"), "details_total_events": has(F.col("total_events"), "R04"),
    })


#: What numbers are not taken from. Keys that end in these or hold that word, keys of addresses, and names of lists whose elements are ids or ports.
LEFT_OUT = r"(_id|_ids)$|timestamp|^(src_ip|source_ip|dest_ip|destination_ip)$"
ONLY_LENGTH = r"_ids$|flow_id|port"


def harvested(rows: DataFrame, keys: list[str], document: str, prefix: str = "details") -> DataFrame:
    """(keys, name, value): every finite number of a JSON document by its path, true as 1, and the length of every list.

    Objects and lists are opened level by level, as deep as the deepest document
    goes; a list's elements share its name. Text, null and junk give nothing.
    """
    name, v = F.col("name"), F.col("v")
    cur = rows.select(*keys, F.lit(prefix).alias("name"), F.try_parse_json(document).alias("v")).where("v is not null")
    out = None
    while True:
        kind = F.schema_of_variant(v)
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        fields = F.when(kind.startswith("OBJECT"), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
        x = stored(cur.select(*keys, "name", number.alias("number"), items.alias("items"), fields.alias("fields")), "harvest")
        found = x.select(*keys, "name", F.col("number").alias("value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
        found = found.unionAll(x.where("items is not null").select(*keys, F.concat(name, F.lit("_length")).alias("name"), F.size("items").cast("double").alias("value")))
        out = found if out is None else out.unionAll(found)
        if x.where("items is not null or fields is not null").isEmpty():
            return out
        elements = x.where(F.col("items").isNotNull() & ~F.lower(name).rlike(ONLY_LENGTH)).select(*keys, "name", F.explode("items").alias("v"))
        inner = x.where("fields is not null").select(*keys, "name", F.explode("fields").alias("f")).where(~F.lower("f.key").rlike(LEFT_OUT))
        cur = elements.unionAll(inner.select(*keys, F.concat_ws("_", name, F.col("f.key")).alias("name"), F.col("f.value").alias("v")))


def _counters(rows: DataFrame, prefix: str) -> DataFrame:
    """(case_id, name, value) counting each value."""
    return rows.where("value is not null").groupBy("case_id", F.concat(F.lit(f"{prefix}_"), safe_name(F.col("value")), F.lit("_count")).alias("name")).agg(F.count("*").cast("double").alias("value"))


def case_features(case_rows: DataFrame, findings: DataFrame, session_rows: DataFrame) -> DataFrame:
    """(case_id, name, value): the sparse feature matrix in long form; absent means 0."""
    linked = case_rows.select("case_id", F.explode("finding_ids").alias("finding_id")).join(findings, "finding_id")

    def with_numbers(per: DataFrame, numbers: dict[str, DataFrame]) -> DataFrame:
        """Values are told apart as rows: lists of a case may hold most of the events."""
        for n, df in numbers.items():
            per = per.join(df, "case_id", "left").withColumn(n, F.coalesce(n, F.lit(0.0)))
        return per

    start, end = hour_angle(F.col("first_us")), hour_angle(F.col("last_us"))
    base = case_rows.select("case_id", *[v.cast("double").alias(k) for k, v in {
        "finding_count": F.col("finding_count"), "source_ip_count": F.size("source_ips"), "destination_ip_count": F.size("destination_ips"), "unique_rule_count": F.size("rule_ids"),
        "case_duration_seconds": F.greatest(F.lit(0), F.col("last_us") - F.col("first_us")) / 1e6, "correlation_reason_count": F.size("correlation_reasons"),
        "case_start_hour_sin": F.sin(start), "case_start_hour_cos": F.cos(start), "case_end_hour_sin": F.sin(end), "case_end_hour_cos": F.cos(end)}.items()])
    numbers = finding_numbers(linked)
    per = numbers.groupBy("case_id").agg(
        F.count_if(F.size("flow_ids") > 0).cast("double").alias("findings_with_flow_ids"), F.count_if(F.size("destination_ports") > 0).cast("double").alias("findings_with_destination_ports"),
        *[f(n).alias(f"finding_{n}_{s}") for n in FINDING_NUMBERS for f, s in ((F.sum, "sum"), (F.avg, "mean"), (F.max, "max"))],
    )
    lists = {"finding_destination_ip_count": "destination_ips", "unique_flow_id_count": "flow_ids", "unique_destination_port_count": "destination_ports"}
    per = with_numbers(per, {n: case_ids(case_rows, findings, c, "v").groupBy("case_id").agg(F.count("*").cast("double").alias(n)) for n, c in lists.items()})
    more = base.select("case_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value")).limit(0)
    if "details" in findings.columns:
        # numbers that the rules' own columns don't cover
        found = harvested(linked.select("case_id", "details"), ["case_id"], "details").where(~F.col("name").isin(*FINDING_NUMBERS))
        found = found.groupBy("case_id", "name").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.max("value").alias("max"))
        more = found.unpivot(["case_id", "name"], ["sum", "mean", "max"], "_s", "value").select("case_id", F.concat_ws("_", F.lit("finding"), "name", "_s").alias("name"), "value")
    met = stored(matching_sessions(case_rows, session_rows), "case-sessions")
    sess = met.groupBy("case_id").agg(
        F.count("*").cast("double").alias("matched_session_count"), F.sum("flow_count").cast("double").alias("session_total_flow_count"), F.sum("event_count").cast("double").alias("session_total_event_count"),
        F.count_distinct("proto").cast("double").alias("session_unique_protocol_count"), F.sum("duration_seconds").cast("double").alias("session_duration_total_seconds"), F.avg("duration_seconds").alias("session_duration_mean_seconds"), F.max("duration_seconds").cast("double").alias("session_duration_max_seconds"),
    )
    sess = with_numbers(sess, {n: _distinct(met, c, n) for n, c in (("session_unique_flow_id_count", "flow_ids"), ("session_unique_destination_port_count", "destination_ports"), ("session_unique_source_port_count", "source_ports"))})
    tall = lambda df: df.unpivot(["case_id"], [c for c in df.columns if c != "case_id"], "name", "value").where("value is not null")
    return (
        tall(base).unionByName(tall(per)).unionByName(tall(sess)).unionByName(more)
        .unionByName(_counters(case_rows.select("case_id", F.col("correlation_strength").alias("value")), "correlation_strength"))
        .unionByName(_counters(linked.select("case_id", F.col("rule_id").alias("value")), "rule"))
        .unionByName(_counters(case_rows.select("case_id", F.explode("correlation_reasons").alias("value")), "correlation_reason"))
        .unionByName(_counters(met.select("case_id", F.col("proto").alias("value")), "session_protocol"))
    )


def variable_features(features: DataFrame, n_cases: int) -> list[str]:
    """Names of features that differ between cases, absent counting as 0. Names are bounded by rules, reasons and protocols."""
    clean = F.when(F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value"))
    got = features.groupBy("name").agg(F.min(clean).alias("low"), F.max(clean).alias("high"), F.count("*").alias("n"))
    got = got.withColumns({"low": F.when(F.col("n") < n_cases, F.least("low", F.lit(0.0))).otherwise(F.col("low")), "high": F.when(F.col("n") < n_cases, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))})
    return sorted(r.name for r in got.where("low <> high").select("name").collect())


def wide(features: DataFrame, case_rows: DataFrame) -> DataFrame:
    """A row per case and a column per feature that varies, absent as 0: what the forest is trained on."""
    names = variable_features(features, case_rows.count())
    per = features.groupBy("case_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]) if names else features.select("case_id").distinct()
    return case_rows.select("case_id").join(per, "case_id", "left").fillna(0.0, names)


def _average_path(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random split trees over subsamples; score 2 ** (-mean depth / expected depth), above 0.5 anomalous."""

    def __init__(self, data: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(data))
        self.trees = [self._grow(data[rng.choice(len(data), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = math.ceil(math.log2(max(2, self.size)))
        feature, cut, left, depth = [], [], [], []
        todo = [(x, 0)]
        at = 0
        while at < len(todo):
            rows, d = todo[at]
            varied = np.flatnonzero(rows.min(axis=0) < rows.max(axis=0)) if len(rows) > 1 and d < limit else ()
            if len(varied):
                f = int(rng.choice(varied))
                low, high = rows[:, f].min(), rows[:, f].max()
                c = rng.uniform(low, high)
                side = rows[:, f] < c if (rows[:, f] < c).any() else rows[:, f] <= low
                feature.append(f)
                cut.append(c if (rows[:, f] < c).any() else np.nextafter(low, high))
                left.append(len(todo))
                depth.append(0.0)
                todo += [(rows[side], d + 1), (rows[~side], d + 1)]
            else:
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                depth.append(d + float(_average_path(len(rows))))
            at += 1
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, depth in self.trees:
            node = np.zeros(len(x), int)
            while (inner := feature[node] >= 0).any():
                f = np.where(inner, feature[node], 0)
                node = np.where(inner, left[node] + (x[rows, f] >= cut[node]), node)
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.size)), 1e-12))


def scores(features: DataFrame, case_rows: DataFrame, sample: int = TRAINING_CASES, trees: int = TREES) -> DataFrame:
    """(case_id, isolation_forest_score), null if no feature varies. Trains on at most sample cases, first by hash."""
    every = case_rows.select("case_id")
    names = variable_features(features, every.count())
    if not names:
        return every.withColumn("isolation_forest_score", F.lit(None).cast("double"))
    clean = F.when(F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value")).cast("float")
    maps = features.where(F.col("name").isin(names)).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("name", clean))).alias("m"))
    wide = every.join(maps, "case_id", "left").select("case_id", F.array(*[F.coalesce(F.col("m")[n], F.lit(0.0).cast("float")) for n in names]).alias("x"))
    chosen = wide.orderBy(F.xxhash64("case_id"), "case_id").limit(sample).toPandas()
    forest = IsolationForest(np.array(chosen["x"].tolist(), np.float32), trees)

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["case_id"], "isolation_forest_score": forest.score(np.array(pdf["x"].tolist(), np.float32)) if len(pdf) else []})

    return wide.mapInPandas(score, "case_id string, isolation_forest_score double")


def percentiles(score_rows: DataFrame, column: str = "isolation_forest_score") -> DataFrame:
    """Adds priority_score: average rank among all rows over their number, times 100, to two places.

    Scores are counted once each and their counts summed along ranges of scores,
    as there may be as many scores as rows.
    """
    counts = accumulated(score_rows.groupBy(F.col(column).alias("_score")).agg(F.count("*").alias("_ties")), [F.asc_nulls_first("_score")], {"_upto": F.col("_ties")})
    n = score_rows.agg(F.count("*").alias("_n"))
    middle = F.col("_upto") - (F.col("_ties") - 1) / 2
    ranks = counts.join(F.broadcast(n)).select("_score", round2(middle / F.col("_n") * 100).alias("priority_score"))  # one row
    return score_rows.join(ranks, F.col(column).eqNullSafe(F.col("_score"))).drop("_score")


def ranked(case_rows: DataFrame, score_rows: DataFrame) -> DataFrame:
    """Cases with score, level, class and rank; without any varying feature all score 50, undetermined, in input order."""
    x = percentiles(score_rows)
    x = x.withColumn("priority_score", F.when(F.col("isolation_forest_score").isNull(), 50.0).otherwise(F.col("priority_score")))
    kind = F.when(F.col("isolation_forest_score").isNull(), "Undetermined").when(F.col("isolation_forest_score") > 0.5, "Anomaly").otherwise("Normal")
    x = x.withColumns({"priority_level": priority_level(F.col("priority_score")), "isolation_forest_classification": kind})
    out = case_rows.join(x, "case_id")
    order = [F.desc("priority_score"), F.desc("isolation_forest_score"), F.asc("first_us"), F.asc("case_id")]
    return accumulated(out, order, {"priority_rank": F.lit(1)})
