"""Findings to cases: pairwise relations, connected components, case rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import id_of
from ..sources.tables import stored
from .ranges import by_time

WINDOW_SECONDS, RELATED_WIDTHS = 300, 16
#: Findings of one flow up to which all its pairs are compared.
PAIRED = 16
RELATIONS = ("flow", "source", "time", "dest", "port", "rule")
REASONS = ("Shared flow", "Same source IP", "Within 5-minute window", "Same destination IP", "Overlapping destination port", "Different detection rules")  # fixed values


def _near_pairs(findings: DataFrame, seconds: int) -> DataFrame:
    """(a, b) ordinals of the same source within the window.

    Joined on source and time bucket, each finding also standing in the next
    bucket, so a busy source is spread over its time.
    """
    width = seconds * 1_000_000
    bucket = F.floor(F.col("start_us") / F.lit(max(1, width))).cast("long")
    slim = findings.where("source_ip is not null").select("ordinal", "source_ip", "start_us", bucket.alias("bucket"))
    left = slim.select(F.col("ordinal").alias("a"), "source_ip", F.col("start_us").alias("a_us"), F.explode(F.array("bucket", F.col("bucket") + 1, F.col("bucket") - 1)).alias("bucket"))
    right = slim.select(F.col("ordinal").alias("b"), "source_ip", F.col("start_us").alias("b_us"), "bucket")
    return left.join(right, ["source_ip", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a_us") - F.col("b_us")) <= width)).select("a", "b")


def _flow_members(findings: DataFrame) -> DataFrame:
    """(flow, ordinal)."""
    return findings.select(F.explode(F.array_distinct("flow_ids")).alias("flow"), "ordinal").where("flow is not null")


def _flow_pairs(members: DataFrame) -> DataFrame:
    """(a, b) ordinals of a shared flow, each once for all flows that they share."""
    return members.select("flow", F.col("ordinal").alias("a")).join(members.select("flow", F.col("ordinal").alias("b")), "flow").where("a < b").select("a", "b").distinct()


def _compared(pairs: DataFrame, findings: DataFrame, seconds: int) -> DataFrame:
    """pairs (a, b, ...) with a_ and b_ columns and booleans source, time, dest, port and rule.

    Pairs don't carry lists: each list that differs has a number, and lists are
    held against each other once for all pairs with the same two numbers.
    """
    slim, lists = findings.select("ordinal", "rule_id", "source_ip", "start_us", "destination_ips", "destination_ports"), {}
    for c, k in (("destination_ips", "dest"), ("destination_ports", "port")):
        lists[k] = findings.groupBy(F.col(c).alias("_list")).agg(F.min("ordinal").alias("_n"))
        slim = slim.join(lists[k], F.col(c).eqNullSafe(F.col("_list")), "left").withColumnRenamed("_n", k).drop(c, "_list")
    slim = stored(slim, "compared")
    side = lambda p: slim.select(*[F.col(c).alias(f"{p}_{c}") for c in slim.columns])
    x = stored(pairs.join(side("a"), F.col("a") == F.col("a_ordinal")).join(side("b"), F.col("b") == F.col("b_ordinal")), "pairs")
    for k, rows in lists.items():
        one = lambda p, rows=rows, k=k: rows.select(F.col("_n").alias(f"{p}_{k}"), F.col("_list").alias(f"_{p}"))
        met = x.select(f"a_{k}", f"b_{k}").distinct().join(one("a"), f"a_{k}").join(one("b"), f"b_{k}").where(F.arrays_overlap("_a", "_b"))
        x = x.join(met.select(f"a_{k}", f"b_{k}", F.lit(True).alias(k)), [f"a_{k}", f"b_{k}"], "left").withColumn(k, F.coalesce(k, F.lit(False)))
    return x.withColumns({
        "source": F.coalesce(F.col("a_source_ip") == F.col("b_source_ip"), F.lit(False)), "time": F.abs(F.col("a_start_us") - F.col("b_start_us")) <= seconds * 1_000_000, "rule": F.col("a_rule_id") != F.col("b_rule_id"),
    })


def relations(findings: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Correlated pairs: finding_a, finding_b, strength, reasons (every true relation), a, b, time_difference_seconds."""
    flow = _flow_pairs(_flow_members(findings)).withColumn("flow", F.lit(True))
    pairs = _near_pairs(findings, seconds).withColumn("flow", F.lit(False)).unionByName(flow).groupBy("a", "b").agg(F.max("flow").alias("flow"))
    x = _compared(pairs, findings, seconds)
    apart = F.abs(F.col("a_start_us") - F.col("b_start_us"))
    strength = F.when(F.col("flow") | F.col("source") & F.col("dest") & F.col("time"), "Strong").when(F.col("source") & F.col("time") & (F.col("port") | F.col("rule")), "Moderate")
    reasons = F.array_compact(F.array(*[F.when(F.col(c), r) for c, r in zip(RELATIONS, REASONS, strict=True)]))
    out = x.withColumns({"strength": strength, "reasons": reasons, "time_difference_seconds": apart / 1e6}).where("strength is not null")
    named = lambda c, p: findings.select(F.col("ordinal").alias(p), F.col("finding_id").alias(c))
    out = out.select("a", "b", "strength", "reasons", "time_difference_seconds").join(named("finding_a", "a"), "a").join(named("finding_b", "b"), "b")
    return out.select("finding_a", "finding_b", "strength", "reasons", "a", "b", "time_difference_seconds")


def _chain(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """rows (keys, ordinal, start_us) with before: the ordinal of the row before it among equal keys, if it lies within the window."""
    x, w = _near(rows, keys, seconds)
    near = F.col("start_us") - F.lag("start_us").over(w) <= seconds * 1_000_000
    return x.withColumn("before", F.when(near, F.lag("ordinal").over(w))).where("_own and before is not null")


def _near(rows: DataFrame, keys: list[str], seconds: int):
    """rows dealt to buckets of time, each with its neighbours within the window beside it, and a window over a bucket in order of time."""
    width, size = seconds * 1_000_000, RELATED_WIDTHS * max(1, seconds) * 1_000_000
    bucket = lambda c: F.floor(c / F.lit(size)).cast("long")
    at = F.col("start_us")
    x = rows.withColumn("_bucket", F.explode(F.sequence(bucket(at - width), bucket(at + width)))).withColumn("_own", F.col("_bucket") == bucket(at))
    return x, Window.partitionBy(*keys, "_bucket").orderBy("start_us", "ordinal")


def links(findings: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Edges (a, b, strength, reasons), linearly many, whose components have the same members, greatest strength and reasons as those of relations().

    Findings of one flow are all related: a star. Within one source and a shared
    destination or port, findings at most a window apart are related: whatever lies
    between two of them is related to both, so each one's edge to the one before it
    will do. Findings of one source and different rules: each one's edges to the
    nearest one of another rule before and after it. Other relations can only hold
    beside these, and show in the groups of a flow: by source, time, destination,
    port and rule.
    """
    f = findings.select("ordinal", "rule_id", "source_ip", "start_us", "destination_ips", "destination_ports", "flow_ids")
    edge = lambda x, a, b, strength, *why: x.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(strength).alias("strength"), F.array(*[F.lit(REASONS[k]) for k in why]).alias("reasons"))
    each = lambda c, *more: f.select("ordinal", "start_us", *more, F.explode(F.array_distinct(c)).alias("v")).where("v is not null")
    # only flows with more than one finding have edges
    flow = _flow_members(f)
    members = stored(flow.join(flow.groupBy("flow").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).where("n > 1"), "flow"), "shared-flows")
    # findings share many flows: each pair stands once, whatever it shares
    out = [edge(members.where("ordinal <> first").select("first", "ordinal").distinct(), "first", "ordinal", "Strong", 0)]
    pairs = _compared(_flow_pairs(members.where(F.col("n") <= PAIRED)), f, seconds)
    told = pairs.groupBy("a").agg(*[F.bool_or(c).alias(c) for c in RELATIONS[1:]])
    why = F.array_compact(F.array(*[F.when(F.col(c), r) for c, r in zip(RELATIONS[1:], REASONS[1:], strict=True)]))
    out.append(told.select("a", F.col("a").alias("b"), F.lit("Strong").alias("strength"), why.alias("reasons")).where("size(reasons) > 0"))
    # flows of more findings: linearly many rows instead of pairs
    large = members.where(F.col("n") > PAIRED).join(f.drop("flow_ids"), "ordinal")
    rules = large.groupBy("flow", "first").agg(F.min("rule_id").alias("low"), F.max("rule_id").alias("high")).where("low <> high")
    out += [edge(rules, "first", "first", "Strong", 5), edge(_chain(large, ["flow"], seconds), "before", "ordinal", "Strong", 2)]
    for c, why in (("source_ip", 1), ("destination_ips", 3), ("destination_ports", 4)):
        value = F.col(c) if c == "source_ip" else F.explode(F.array_distinct(c))
        same = large.select("flow", "ordinal", value.alias("v")).where("v is not null").groupBy("flow", "v").agg(F.min("ordinal").alias("one"), F.max("ordinal").alias("other")).where("one <> other")
        out.append(edge(same.select("one", "other").distinct(), "one", "other", "Strong", why))
    placed = f.where("source_ip is not null")
    for c, why, strength in (("destination_ips", 3, "Strong"), ("destination_ports", 4, "Moderate")):
        out.append(edge(_chain(each(c, "source_ip").where("source_ip is not null"), ["source_ip", "v"], seconds), "before", "ordinal", strength, 1, 2, why))
    x, w = _near(placed.select("ordinal", "rule_id", "source_ip", "start_us"), ["source_ip"], seconds)
    back = Window.partitionBy("source_ip", "_bucket").orderBy(F.desc("start_us"), F.desc("ordinal"))
    for n, order in (("before", w), ("after", back)):
        turn = F.when(F.lag("rule_id").over(order) != F.col("rule_id"), F.struct(F.lag("ordinal").over(order).alias("ordinal"), F.lag("start_us").over(order).alias("us")))
        x = x.withColumn(f"_{n}", turn).withColumn(f"_{n}", F.last(f"_{n}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        near = F.abs(F.col(f"_{n}.us") - F.col("start_us")) <= seconds * 1_000_000
        x = x.withColumn(n, F.when(near, F.col(f"_{n}.ordinal")))
    x = x.where("_own").select("ordinal", F.explode(F.array_compact(F.array("before", "after"))).alias("other"))
    out.append(edge(x, "ordinal", "other", "Moderate", 1, 2, 5))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable. nodes: id. Labels spread to neighbours and then jump to their label's label."""
    pairs = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select("b", "a")).distinct(), "edges")
    labels = stored(nodes.select("id", F.col("id").alias("root")), "labels")
    while True:
        near = pairs.join(labels, F.col("y") == F.col("id")).groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("id") == F.col("x"), "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = step.select(F.col("id").alias("p"), F.col("root").alias("g"))
        nxt = stored(step.join(up, F.col("root") == F.col("p")).select("id", F.least("root", "g").alias("root"), "old"), "labels")
        if nxt.where("root <> old").isEmpty():
            return nxt.select("id", "root")
        labels = nxt.drop("old")


def cases(findings: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """One row per component of findings, numbered by first start; relation_rows as links() or relations() give them."""
    findings, relation_rows = stored(findings.select("ordinal", "finding_id", "rule_id", "source_ip", "start_us", "destination_ips"), "findings"), stored(relation_rows, "relations")
    roots = components(relation_rows.select("a", "b"), findings.select(F.col("ordinal").alias("id")))
    rows = findings.join(roots, F.col("ordinal") == F.col("id"))
    got = rows.groupBy("root").agg(
        F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"), F.array_sort(F.collect_set("source_ip")).alias("source_ips"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "finding_id"))), lambda s: s["finding_id"]).alias("finding_ids"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.count("*").alias("finding_count"),
    )
    # values are told apart before they are gathered: a case may have most findings and edges
    ips = rows.select("root", F.explode("destination_ips").alias("v")).distinct().groupBy("root").agg(F.array_sort(F.collect_list("v")).alias("destination_ips"))
    why = relation_rows.join(roots, F.col("a") == F.col("id")).select("root", "strength", F.explode("reasons").alias("v")).distinct()
    linked = why.groupBy("root").agg(F.min("strength").alias("weak"), F.max("strength").alias("strong"), F.array_sort(F.collect_set("v")).alias("correlation_reasons"))
    out = got.join(ips, "root", "left").join(linked, "root", "left").withColumn("correlation_strength", F.coalesce("strong", F.lit("Single")))
    out = out.withColumns({"destination_ips": F.coalesce("destination_ips", F.array().cast("array<string>")), "correlation_reasons": F.coalesce("correlation_reasons", F.array().cast("array<string>"))})
    return by_time(stored(out, "cases"), "_number", "first_us", [F.col("root")]).withColumn("case_id", id_of("CASE", F.col("_number"))).drop("root", "weak", "strong", "_number")


def case_findings(case_rows: DataFrame) -> DataFrame:
    return case_rows.select("case_id", F.explode("finding_ids").alias("finding_id"))


def missing_findings(case_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Finding ids named by cases that do not exist; must be empty before cases are stored."""
    return case_findings(case_rows).join(findings.select("finding_id"), "finding_id", "left_anti")


def evaluation(case_rows: DataFrame) -> DataFrame:
    """Distribution rows (dimension, value, cases): findings per case, strength and reasons."""
    one = lambda d, c: case_rows.select(F.lit(d).alias("dimension"), c.cast("string").alias("value"))
    rows = one("findings", F.col("finding_count")).unionAll(one("strength", F.col("correlation_strength"))).unionAll(case_rows.select(F.lit("reason").alias("dimension"), F.explode("correlation_reasons").alias("value")))
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("cases"))


def co_membership(case_rows: DataFrame, finding_ids: list[str]) -> DataFrame:
    """Cases that hold all of the given findings."""
    return case_rows.where(F.size(F.array_except(F.array(*map(F.lit, finding_ids)), "finding_ids")) == 0)
