"""Queries behind the overview, timeline, evidence, case and alert pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 8
#: Parts of a pattern that see where a column ends: anchors, negated classes, groups with options, escapes other than of digits, word characters and marks.
ACROSS = re.compile(r"[\^$\n]|\(\?|\\(?![.dw])\w")
EVIDENCE_COLUMNS = ("case_id", "finding_id", "rule_id", "event_id", "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "ts")


def daily_counts(events: DataFrame) -> DataFrame:
    return events.where("us is not null").groupBy(F.to_date(F.timestamp_micros("us")).alias("day")).agg(F.count("*").alias("events"))


def type_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "event_type")


def suspicious_events(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("event_ids").alias("id")).agg(F.count_distinct("id").alias("suspicious"))


def options(events: DataFrame, column: str) -> DataFrame:
    return events.select(F.col(column).alias("option")).where("option is not null").distinct().orderBy("option")


def filtered(events: DataFrame, **equal) -> DataFrame:
    """Equality filters; None and "All" filter nothing."""
    for column, value in equal.items():
        if value not in (None, "All"):
            events = events.where(F.col(column) == value)
    return events


def timeframe(events: DataFrame, hours: int | None = None, year: int | None = None) -> DataFrame:
    """The last hours before the newest event, ends included, or a calendar year."""
    if year is not None:
        return events.where(F.year(F.timestamp_micros("us")) == year)
    if hours is None:
        return events.where("us is not null")
    newest = events.agg(F.max("us").alias("us")).first().us
    return events.where(F.col("us") >= (newest - hours * 3_600_000_000 if newest is not None else 0))


def search(df: DataFrame, pattern: str, columns=None) -> DataFrame:
    """Rows with a column that matches the pattern, a regular expression, in lower case.

    All columns are joined by line feeds and searched once, unless the pattern could
    match a line feed or the ends of a column (see ACROSS).
    """
    if not pattern:
        return df
    text = [F.lower(F.col(c).cast("string")) for c in columns or df.columns]
    if not ACROSS.search(pattern):
        return df.where(F.concat_ws("\n", *text).rlike(pattern.lower()))
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(c.rlike(pattern.lower()), F.lit(False)) for c in text]))


def page(df: DataFrame, number: int, order: list, rows: int = PAGE_ROWS) -> DataFrame:
    """One page of rows; page numbers outside are moved to the nearest page."""
    pages = max(1, -(-df.count() // rows))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * rows).limit(rows)


def alerts(events: DataFrame) -> DataFrame:
    return events.where("alert_sid is not null").orderBy("us", "id")


def case_findings_of(case_rows: DataFrame, findings: DataFrame, case_id: str | None = None) -> DataFrame:
    picked = case_rows if case_id is None else case_rows.where(F.col("case_id") == case_id)
    return picked.select("case_id", F.explode("finding_ids").alias("finding_id")).join(findings, "finding_id")


def evidence_rows(case_rows: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """A row per case, finding and event of the finding."""
    x = case_findings_of(case_rows, findings).select("case_id", "finding_id", "rule_id", F.explode("event_ids").alias("event_id"))
    return x.join(events.withColumnRenamed("id", "event_id"), "event_id").select(*[c for c in EVIDENCE_COLUMNS if c != "ts"], "us")


def case_detail_events(case_rows: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """Events of a case by event ids; by flow ids for cases whose event ids find nothing."""
    from .evidence import case_ids

    by_id = case_ids(case_rows, findings, "event_ids", "id").join(events, "id").select("case_id", *events.columns)
    found = by_id.select("case_id").distinct()
    by_flow = case_ids(case_rows.join(found, "case_id", "left_anti"), findings, "flow_ids", "flow_id").join(events, "flow_id")
    return by_id.unionByName(by_flow.select("case_id", *events.columns))


def filter_cases(case_rows: DataFrame, **equal) -> DataFrame:
    return filtered(case_rows, **equal)


def with_missing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed old to new; those absent are there as nulls."""
    return df.select("*", *[F.lit(None).cast("string").alias(o) for o in names if o not in df.columns]).withColumnsRenamed(names)
