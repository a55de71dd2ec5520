"""Cases to events, flow selectors and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranges import bucket_of, by_time, in_buckets

PADDING_SECONDS = 2.0
#: No port; selectors of one key up to which all are compared with a packet.
ANY, BUSY = -(1 << 31), 64
TUPLE = ("src_ip", "src_port", "dest_ip", "dest_port", "proto")


def case_ids(case_rows: DataFrame, findings: DataFrame, column: str, name: str) -> DataFrame:
    """(case_id, name): the distinct values of a list of its findings (event_ids or flow_ids), a row each, as one case may hold most events."""
    links = case_rows.select("case_id", F.explode("finding_ids").alias("finding_id"))
    return links.join(findings.select("finding_id", F.explode(column).alias(name)), "finding_id").where(F.col(name).isNotNull()).select("case_id", name).distinct()


def case_events(case_rows: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, event columns): events named by id or by flow, each once per case."""
    flows = stored(case_ids(case_rows, findings, "flow_ids", "flow_id"), "case-flows")
    by_flow = flows.join(events, "flow_id")
    # named by id alone: events whose flow isn't among the case's
    by_id = case_ids(case_rows, findings, "event_ids", "id").join(events, "id").join(flows, ["case_id", "flow_id"], "left_anti")
    return by_id.select("case_id", *events.columns).unionByName(by_flow.select("case_id", *events.columns))


def selectors(case_event_rows: DataFrame) -> DataFrame:
    """Five-tuples of a case's events with their time range, ordered within the case."""
    got = case_event_rows.where("src_ip is not null and dest_ip is not null and us is not null").groupBy("case_id", *TUPLE).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    order = [F.col("first_us"), F.col("src_ip"), F.col("dest_ip"), F.coalesce("src_port", F.lit(-1)), F.coalesce("dest_port", F.lit(-1)), F.asc_nulls_first("proto")]
    return by_time(stored(got, "selectors"), "ord", "first_us", order[1:], within=("case_id",)).withColumn("ord", F.col("ord").cast("int"))


def transport(packets: DataFrame):
    """TCP or UDP in lower case where a packet's fields tell, else null; names of higher protocols don't."""
    stream = F.col("tcp_stream").isNotNull() if "tcp_stream" in packets.columns else F.lit(False)
    if "protocol" not in packets.columns:
        return F.when(stream, "tcp")
    return F.when(stream, "tcp").when(F.lower("protocol").isin("tcp", "udp"), F.lower("protocol"))


def _oriented(selector_rows: DataFrame) -> DataFrame:
    """Each selector forward and, where the ends differ, reversed; the forward one is tried first."""
    ends = ("src_ip", "src_port", "dest_ip", "dest_port")
    keep = ["case_id", "ord", "first_us", "last_us"]
    if "proto" in selector_rows.columns:
        named = F.lower(F.trim("proto"))
        selector_rows = selector_rows.withColumn("s_proto", F.when(named.isin("tcp", "udp"), named))
    else:
        selector_rows = selector_rows.withColumn("s_proto", F.lit(None).cast("string"))
    keep.append("s_proto")
    forward = selector_rows.select(*keep, *[F.col(c).alias(f"s_{c}") for c in ends], F.lit("forward").alias("direction"))
    back = selector_rows.where("src_ip <> dest_ip").select(*keep, *[F.col(a).alias(f"s_{b}") for a, b in zip(("dest_ip", "dest_port", "src_ip", "src_port"), ends, strict=True)], F.lit("reverse").alias("direction"))
    return forward.unionByName(back)


def packet_matches(packets: DataFrame, selector_rows: DataFrame, padding_seconds: float = PADDING_SECONDS, timed: bool = True) -> DataFrame:
    """(case_id, packet columns, direction): a packet in a case by its first matching selector.

    Addresses and ports must agree in one direction, a null selector port fits
    any; TCP and UDP must agree where both are known; with timed the packet's time must lie in the padded range. Addresses
    and ports are the join key, a packet standing once for each way in which
    selectors leave ports open. With timed, where more than BUSY selectors share a
    key, time joins it: a range stands in the one or two buckets of its length that
    it touches, a packet in a bucket of each length.
    """
    pad = int(padding_seconds * 1_000_000)
    s = _oriented(selector_rows).withColumns({"_from": F.col("first_us") - pad, "_to": F.col("last_us") + pad})
    s = s.withColumns({"_open": F.col("s_src_port").isNull().cast("int") * 2 + F.col("s_dest_port").isNull().cast("int"), "_rank": F.col("ord").cast("long") * 2 + (F.col("direction") == "reverse").cast("int")})
    s = stored(s.select("case_id", "s_proto", "s_src_ip", "s_dest_ip", F.coalesce("s_src_port", F.lit(ANY)).alias("s_src_port"), F.coalesce("s_dest_port", F.lit(ANY)).alias("s_dest_port"), "_open", "_from", "_to", "_rank"), "oriented")
    names, keys = packets.columns, ["src_ip", "dest_ip", "src_port", "dest_port"]
    known = s.select("_open").distinct()  # four at most
    p = packets.where("src_ip is not null and dest_ip is not null").withColumn("_transport", transport(packets)).join(F.broadcast(known))
    port = lambda c, bit: F.when(F.col("_open").bitwiseAND(bit) != 0, ANY).otherwise(F.col(c))
    p = p.select(*names, "_transport", *[F.col(c).alias(f"_{c}") for c in keys[:2]], port("src_port", 2).alias("_src_port"), port("dest_port", 1).alias("_dest_port"))
    same = [F.col(f"_{c}") == F.col(f"s_{c}") for c in keys]
    fits = F.col("s_proto").isNull() | F.col("_transport").isNull() | (F.col("s_proto") == F.col("_transport"))
    if timed:
        ends = [f"s_{c}" for c in keys]
        busy = s.groupBy(*ends).agg(F.count("*").alias("_n")).where(F.col("_n") > BUSY).select(*ends)
        hot, at = s.join(busy, ends, "left_semi"), F.col("packet_us")
        inside = at.between(F.col("_from"), F.col("_to"))
        few = p.join(s.join(busy, ends, "left_anti"), [*same, fits, inside])
        dealt = in_buckets(hot, "_from", "_to")
        points = p.join(busy, same, "left_semi").join(F.broadcast(dealt.select("_level").distinct()))  # as many as lengths
        x = few.unionByName(points.withColumn("_p", bucket_of(at, F.col("_level"))).withColumnRenamed("_level", "_l").join(dealt, [*same, F.col("_l") == F.col("_level"), F.col("_p") == F.col("_bucket"), fits, inside]).select(*few.columns))
    else:
        x = p.join(s, [*same, fits])
    got = ["case_id", *names]
    best = x.groupBy(*got).agg(F.min("_rank").alias("_rank"))
    return best.select(*got, F.when(F.col("_rank") % 2 == 1, "reverse").otherwise("forward").alias("direction"))


def display_filter(selector_rows: DataFrame, padding_seconds: float = PADDING_SECONDS) -> DataFrame:
    """(case_id, ord, filter): a capture tool's boolean expression for each selector: protocol, both directions and padded time.

    Ports are named by TCP or UDP; another protocol stands by its name and has
    none. Selectors whose ends are of two address families match no packet and
    are left out.
    """
    proto = F.lower(F.trim(F.coalesce("proto", F.lit(""))))
    ported, v6 = proto.isin("tcp", "udp"), F.col("src_ip").contains(":")
    family = F.when(v6, "ipv6").otherwise("ip")

    def part(a: str, b: str):
        port = lambda c, side: F.when(ported & F.col(c).isNotNull(), F.concat(F.lit(" && "), proto, F.lit(f".{side}port == "), F.col(c).cast("string"))).otherwise("")
        return F.concat(F.lit("("), family, F.lit(".src == "), F.col(f"{a}_ip"), F.lit(" && "), family, F.lit(".dst == "), F.col(f"{b}_ip"), port(f"{a}_port", "src"), port(f"{b}_port", "dst"), F.lit(")"))

    second = lambda c, d: ((F.col(c) + int(d * 1_000_000)).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string")
    time = F.concat(F.lit(" && frame.time_epoch >= "), second("first_us", -padding_seconds), F.lit(" && frame.time_epoch <= "), second("last_us", padding_seconds))
    named = F.when(proto != "", F.concat(proto, F.lit(" && "))).otherwise("")
    whole = selector_rows.where(v6 == F.col("dest_ip").contains(":"))
    return whole.select("case_id", "ord", F.concat(named, F.lit("("), part("src", "dest"), F.lit(" || "), part("dest", "src"), F.lit(")"), time).alias("filter"))


FILTER_CHUNK = 10_000


def filter_batches(filters: DataFrame, most: int = 6000, by: str = "case_id") -> DataFrame:
    """(by, batch, filter): filters of a case, or of all cases of a capture, joined by "or" into expressions of at most `most` characters; a longer filter is one of its own.

    Filters are taken in order (by case and number) and a batch is closed when
    the next one doesn't fit. Each FILTER_CHUNK numbers of a case start a batch of
    their own, so that a task holds no more than one chunk of filters in order.
    """
    order = list(dict.fromkeys([by, "chunk", "case_id", "ord"]))
    rows = filters.withColumn("chunk", F.floor(F.col("ord") / FILTER_CHUNK).cast("long")).select(*order, "filter")
    dealt = rows.repartition(by, "chunk").sortWithinPartitions(*order)

    def packed(batches):
        import pandas as pd

        key, held, size, n = None, [], 0, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                own = (getattr(r, by), r.chunk)
                if held and (own != key or size + 4 + len(r.filter) > most):
                    out.append((*key, n, " || ".join(held)))
                    held, size, n = [], 0, n + 1
                if own != key:
                    key, n = own, 0
                held.append(r.filter)
                size += len(r.filter) + (4 if size else 0)
            yield pd.DataFrame(out, columns=[by, "chunk", "n", "filter"])
        if held:
            yield pd.DataFrame([(*key, n, " || ".join(held))], columns=[by, "chunk", "n", "filter"])

    x = dealt.mapInPandas(packed, f"{by} string, chunk long, n long, filter string")
    number = F.row_number().over(Window.partitionBy(by).orderBy("chunk", "n"))
    return x.select(by, number.alias("batch"), "filter")


def capture_filters(filters: DataFrame, assignment: DataFrame, captures: DataFrame) -> DataFrame:
    """(pcap_path, case_id, ord, filter) of the cases of each capture, so that one pass over a capture serves them all; a case without captures of its own has all."""
    own = assignment.where("pcap_path is not null")
    rest = assignment.where("pcap_path is null").select("case_id", F.lit(1).alias("_k")).join(captures.select("pcap_path", F.lit(1).alias("_k")).distinct(), "_k").select("case_id", "pcap_path")
    return filters.join(own.select("case_id", "pcap_path").unionByName(rest), "case_id").select("pcap_path", "case_id", "ord", "filter")


def capture_assignment(case_rows: DataFrame, captures: DataFrame) -> DataFrame:
    """(case_id, pcap_path): captures whose name holds the UTC date of the case's start; a null path, for all captures, for cases without such."""
    dated = captures.withColumn("name", F.element_at(F.split("pcap_path", "/"), -1))
    dated = dated.withColumn("day", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("name", F.lit(r"(?=(\d{4}-?\d{2}-?\d{2}))"), 1), lambda d: F.regexp_replace(d, "-", "")))))
    c = case_rows.select("case_id", F.date_format(F.timestamp_micros("first_us"), "yyyyMMdd").alias("day"))
    return c.join(dated.select("day", "pcap_path").distinct(), "day", "left").select("case_id", "pcap_path").distinct()


def needed_captures(captures: DataFrame, assignment: DataFrame) -> DataFrame:
    """Of captures (pcap_path, ...) those that some case is assigned to: all of them if some case has a null path."""
    some = assignment.where("pcap_path is null").limit(1).select(F.lit(True).alias("_all"))
    named = assignment.select("pcap_path").where("pcap_path is not null").distinct().select("pcap_path", F.lit(True).alias("_named"))
    x = captures.join(named, "pcap_path", "left").join(F.broadcast(some), how="left")  # one row
    return x.where("_named or _all").drop("_named", "_all")


def in_assigned(packet_rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows (case_id, pcap_path, ...) in a capture that is assigned to their case, or whose case has all captures."""
    a = assignment.select(F.col("case_id").alias("_case"), F.col("pcap_path").alias("_path"))
    return packet_rows.join(a, (F.col("case_id") == F.col("_case")) & (F.col("_path").isNull() | (F.col("_path") == F.col("pcap_path"))), "left_semi")


def by_packet_time(evidence_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored evidence in order of packet time."""
    out = evidence_rows.orderBy("packet_us", "case_id", "pcap_path", "packet_number")
    return out.limit(limit) if limit else out


def merge_packets(batches: list[DataFrame]) -> DataFrame:
    """Packets of several reads of the same captures, one row per (file, number)."""
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    return every.dropDuplicates(["pcap_path", "packet_number"])
