"""Event log lines: numbered NDJSON files to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import community_id, let
from ..functions.values import parse_time
from .tables import stored

EXCLUDED_TYPES = ("stats", "mdns", "dhcp")  # fixed values
MOST_BLOCKS = 500_000


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """(source_file, line_no, raw): physical 1-based line numbers of text files.

    A file's partitions are numbered in order of their offset; line numbers are a
    count per partition, a running sum over these counts and an index inside, so
    files are split and no file is read by one task. The lines aren't shuffled: the
    counts, one row per partition of a file, are broadcast, and only beyond
    MOST_BLOCKS of them joined by shuffle. A file is named by its path, as files of
    one name in several folders are different files. A path given twice is read once.
    """
    paths = paths if isinstance(paths, str) else list(dict.fromkeys(paths))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"), F.col("value").alias("raw"))
    per = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(per.withColumn("before", before).select("source_file", "block", "before", "first"), "line-blocks")
    return lines.join(small(offsets), ["source_file", "block"]).select("source_file", (F.col("before") + F.col("mono") - F.col("first") + 1).alias("line_no"), "raw")


def input_files(spark: SparkSession, paths) -> DataFrame:
    """(source_file) of the given inputs, a row per file; no file's content is read."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("source_file"))


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its counted rows are at most MOST_BLOCKS, else as it is."""
    return F.broadcast(df) if df.count() <= MOST_BLOCKS else df


def _judged(raw: Column) -> Column:
    """(status, event_type) of a trimmed line; each part of it is computed once."""
    # get_json_object also reads objects with repeated keys, which a strict variant parse refuses
    whole = raw.startswith("{") & raw.endswith("}") & (F.try_parse_json(raw).isNotNull() | F.get_json_object(raw, "$").isNotNull())
    parts = F.struct(F.coalesce(whole, F.lit(False)).alias("whole"), F.get_json_object(raw, "$.event_type").alias("kind"), raw.rlike(r'"timestamp"\s*:').alias("timed"), (raw == "").alias("blank"))
    status = lambda x: F.when(x["blank"], "blank").when(~x["whole"] | ~x["timed"] | x["kind"].isNull(), "malformed").when(x["kind"].isin(*EXCLUDED_TYPES), "skipped").otherwise("event")
    return let(parts, lambda x: F.struct(status(x).alias("status"), F.when(x["whole"], x["kind"]).alias("event_type")))


def classified(lines: DataFrame) -> DataFrame:
    """Adds status: blank, malformed, skipped or event, and event_type."""
    x = lines.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).withColumn("_judged", let(F.col("raw"), _judged))
    return x.select(*lines.columns, "_judged.event_type", "_judged.status")


#: Every field as text, so odd types leave nulls instead of errors.
LINE = (
    "struct<timestamp:string,flow_id:string,community_id:string,src_ip:string,src_port:string,dest_ip:string,dest_port:string,proto:string,app_proto:string,flow:struct<start:string,end:string>,"
    "ssh:struct<client:struct<software_version:string>>,http:struct<http_method:string,url:string>,alert:struct<signature_id:string,signature:string,severity:string>>"
)


LINE_BITS = 36


def file_numbers(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_file, file_no): files that are known keep their number, new ones go on from there in order of path. A row per file."""
    names = lines.select("source_file").distinct()
    if known is None:
        return names.withColumn("file_no", F.row_number().over(Window.orderBy("source_file")).cast("long"))
    top = known.agg(F.coalesce(F.max("file_no"), F.lit(0)).alias("top"))
    fresh = names.join(known, "source_file", "left_anti").withColumn("n", F.row_number().over(Window.orderBy("source_file"))).join(F.broadcast(top), F.lit(True))  # one row
    return known.select("source_file", "file_no").unionByName(fresh.select("source_file", (F.col("top") + F.col("n")).alias("file_no")))


def events_of(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Typed events of classified lines, each parsed once; a null timestamp or a flow that is no object leaves nulls.

    An id is the number of its file (see file_numbers) and of its line: no two events
    share one, and lines read again with the same file numbers keep theirs. Lines of
    files without a number are left out before they are parsed.
    """
    rows = lines.where("status = 'event'").join(files if files is not None else file_numbers(lines), "source_file").withColumn("v", F.from_json("raw", LINE))
    v = lambda p: F.col(f"v.{p}")
    n = lambda p, kind: v(p).try_cast(kind)
    x = rows.select(
        "source_file", "file_no", "line_no", parse_time(v("timestamp")).alias("ts"), v("timestamp").alias("ts_raw"), "event_type", n("flow_id", "long").alias("flow_id"), v("community_id").alias("given_community_id"),
        v("src_ip").alias("src_ip"), n("src_port", "int").alias("src_port"), v("dest_ip").alias("dest_ip"), n("dest_port", "int").alias("dest_port"), v("proto").alias("proto"), v("app_proto").alias("app_proto"),
        parse_time(v("flow.start")).alias("flow_start"), parse_time(v("flow.end")).alias("flow_end"), v("ssh.client.software_version").alias("ssh_client_software"), v("http.http_method").alias("http_method"), v("http.url").alias("http_url"),
        n("alert.signature_id", "long").alias("alert_sid"), v("alert.signature").alias("alert_signature"), n("alert.severity", "int").alias("alert_severity"), "raw",
    )
    made = community_id(F.col("src_ip"), F.col("src_port"), F.col("dest_ip"), F.col("dest_port"), F.col("proto"), ipv6=True)
    x = x.withColumn("community_id", F.coalesce("given_community_id", made)).drop("given_community_id")
    return x.withColumn("id", F.shiftleft("file_no", LINE_BITS) + F.col("line_no")).drop("file_no").withColumns({"us": F.unix_micros("ts"), "flow_start_us": F.unix_micros("flow_start"), "flow_end_us": F.unix_micros("flow_end")})


def summary(lines: DataFrame) -> DataFrame:
    """Counts by status and event type."""
    return lines.groupBy("status", "event_type").agg(F.count("*").alias("lines"))
