"""End-to-end runs: ingest, analysis, anomaly detection, packet evidence, prioritization."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, correlation, evidence, prioritize, rules, sessions
from ..sources import captures, ndjson, pcap, tables


@dataclass(frozen=True)
class Settings:
    r01: rules.Rule = rules.R01
    r02: rules.Rule = rules.R02
    r03: rules.Rule = rules.R03
    r04: rules.Rule = rules.R04
    gap_seconds: int = sessions.GAP_SECONDS
    case_seconds: int = correlation.WINDOW_SECONDS
    window_seconds: int = anomaly.WINDOW_SECONDS
    threshold: float = anomaly.THRESHOLD
    min_windows: int = anomaly.MIN_WINDOWS
    padding_seconds: float = evidence.PADDING_SECONDS

    def wide(self, seconds: int, threshold: int = 3) -> Settings:
        """Rules with one window length, for sparse data."""
        new = {n: replace(getattr(self, n), seconds=seconds, threshold=threshold) for n in ("r01", "r02", "r03")}
        return replace(self, **new, r04=replace(self.r04, seconds=seconds), case_seconds=seconds)


def ingest(spark: SparkSession, inputs, root: str) -> DataFrame:
    """Stores new events, those whose time can't be read with a null time; returns counts by status and type.

    Lines already stored are not stored again. Events of files read for the first
    time can't be stored yet, so they are added without a shuffle or a look at what
    is stored; those of files read again (grown ones, or a run that broke off) are
    compared with the stored ones whose ids lie among these files'.
    """
    lines = ndjson.classified(ndjson.numbered_lines(spark, inputs))
    known = tables.scan(spark, root, "files") if tables.exists(spark, f"{root}/files") else spark.createDataFrame([], "source_file string, file_no long")
    names = ndjson.input_files(spark, inputs)
    again = tables.stored(known.join(names, "source_file", "left_semi"), "read-again")
    first, last = again.agg(F.min("file_no"), F.max("file_no")).first()
    tables.append_new(ndjson.file_numbers(names, known), root, "files")
    fresh = tables.stored(tables.scan(spark, root, "files").join(names, "source_file", "left_semi").join(again.select("source_file"), "source_file", "left_anti"), "read-first")
    new = 0
    if not fresh.isEmpty() or first is None:
        new += tables.append(ndjson.events_of(lines, ndjson.small(fresh)), root, "events")
    if first is not None:
        among = f"id >= {first << ndjson.LINE_BITS} and id < {last + 1 << ndjson.LINE_BITS}"
        new += tables.append_new(ndjson.events_of(lines, ndjson.small(again)), root, "events", among=among)
    return ndjson.summary(lines).withColumn("new_rows", F.lit(new))


def detect(events: DataFrame, s: Settings = Settings(), failed=None, anomalous=None) -> DataFrame:
    return rules.all_findings([rules.high_connection_rate(events, s.r01), rules.multi_port(events, s.r02), rules.failed_authentication(events, failed, s.r03), rules.protocol_anomaly(events, anomalous, s.r04)])


ANALYSED = ("sessions", "session_flows", "findings", "cases", "case_findings")
ANOMALIES = ("anomaly_windows", "anomaly_baselines", "anomaly_findings", "anomaly_events")


def analyse(spark: SparkSession, root: str, s: Settings = Settings(), with_anomaly: bool = False) -> None:
    """Sessions, findings and cases anew from the stored events; readers see all of them or those of the run before."""
    events, run = tables.scan(spark, root, "events"), tables.new_run()
    base = f"{root}/{run}"
    got = sessions.sessions(sessions.flows(events), s.gap_seconds)
    tables.replace(got, base, "sessions")
    tables.replace(sessions.session_flows(tables.scan(spark, base, "sessions")), base, "session_flows")
    tables.replace(rules.described(detect(events, s)), base, "findings")
    findings = tables.scan(spark, base, "findings")
    case_rows = correlation.cases(findings, correlation.links(findings, s.case_seconds))
    tables.store_cases(case_rows, correlation.case_findings(case_rows), findings, base)
    tables.publish(spark, root, run, ANALYSED)
    tables.clear(spark)
    if with_anomaly:
        detect_anomalies(spark, root, s)


def detect_anomalies(spark: SparkSession, root: str, s: Settings = Settings()) -> None:
    """Windows, baselines, findings and links of one window length; other lengths stay as they are."""
    anomaly.check(s.window_seconds, s.threshold, s.min_windows)
    run_id = uuid.uuid4().hex

    def note(status: str, findings: int | None = None, error: str | None = None) -> None:
        row = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), F.lit(s.window_seconds).alias("window_seconds"), F.lit(s.threshold).alias("threshold"), F.lit(findings).cast("long").alias("findings"), F.lit(error).cast("string").alias("error"))
        row.write.mode("append").parquet(f"{root}/anomaly_runs")

    note("started")
    try:
        note("finished", _anomaly_tables(spark, root, s))
    except Exception as e:
        note("failed", error=str(e)[:500])
        raise


def _anomaly_tables(spark: SparkSession, root: str, s: Settings) -> int:
    """Writes the four tables of one window length, each from the one before, and publishes them; returns the number of findings."""
    events, run = tables.scan(spark, root, "events"), tables.new_run()

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.replace(df.drop("window_seconds").withColumn("window_seconds", F.lit(s.window_seconds)), f"{root}/{run}", name)
        return tables.scan(spark, f"{root}/{run}", name)

    windows = kept(anomaly.windows(events, s.window_seconds), "anomaly_windows")
    lines = kept(anomaly.baselines(windows, s.min_windows), "anomaly_baselines")
    found = kept(anomaly.findings(windows, lines, s.window_seconds, s.threshold), "anomaly_findings")
    kept(anomaly.linked_events(events, found, s.window_seconds), "anomaly_events")
    tables.publish(spark, root, run, ANOMALIES, str(s.window_seconds))
    return found.count()


def case_filters(spark: SparkSession, root: str, case_ids=None, limit: int | None = None, padding_seconds: float = evidence.PADDING_SECONDS) -> DataFrame:
    """(case_id, batch, filter) of the chosen cases."""
    case_rows = _chosen(tables.scan(spark, root, "cases"), case_ids, limit)
    linked = evidence.case_events(case_rows, tables.scan(spark, root, "findings"), tables.scan(spark, root, "events"))
    return evidence.filter_batches(evidence.display_filter(evidence.selectors(linked), padding_seconds))


def _chosen(case_rows: DataFrame, case_ids, limit: int | None) -> DataFrame:
    if case_ids:
        case_rows = case_rows.where(F.col("case_id").isin(*case_ids))
    return case_rows.orderBy("first_us", "case_id").limit(limit) if limit else case_rows


def link_evidence(spark: SparkSession, root: str, packets: DataFrame | None = None, s: Settings = Settings(), case_ids=None, limit: int | None = None, files: DataFrame | None = None) -> tuple[int, int]:
    """Links cases to events and packets; returns how many links and packets were new.

    Packets are given, read from captures (pcap_path, size), or both. Of the
    captures only those that some case is assigned to are opened.
    """
    case_rows = _chosen(tables.scan(spark, root, "cases"), case_ids, limit)
    findings, events = tables.scan(spark, root, "findings"), tables.scan(spark, root, "events")
    linked = evidence.case_events(case_rows, findings, events)
    links = tables.append_new(linked.select("case_id", F.col("id").alias("event_id")), root, "case_eve_events")
    reads = [] if packets is None else [packets if "packet_us" in packets.columns else pcap.with_micros(packets)]
    names = files.select("pcap_path") if files is not None else reads[0].select("pcap_path").distinct()
    if files is not None and reads:
        names = names.union(reads[0].select("pcap_path")).distinct()
    assignment = tables.stored(evidence.capture_assignment(case_rows, names), "assignment")
    if files is not None:
        reads.append(captures.packets(evidence.needed_captures(files, assignment)))
    every = reads[0] if len(reads) == 1 else evidence.merge_packets([r.select(*reads[-1].columns) for r in reads])
    matched = evidence.packet_matches(every, evidence.selectors(linked), s.padding_seconds)
    return links, tables.append_new(evidence.in_assigned(matched, assignment), root, "pcap_evidence")


def features(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, name, value) of the stored cases."""
    return prioritize.case_features(*(tables.scan(spark, root, t) for t in ("cases", "findings", "sessions")))


def prioritized(spark: SparkSession, root: str, trees: int = prioritize.TREES, embed: bool = False) -> DataFrame:
    """Stored cases, ranked; with embed each with a map of its features."""
    case_rows, found = tables.scan(spark, root, "cases"), tables.stored(features(spark, root), "features")
    out = prioritize.ranked(case_rows, prioritize.scores(found, case_rows, trees=trees))
    if embed:
        out = out.join(found.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("features")), "case_id", "left")
    return out
