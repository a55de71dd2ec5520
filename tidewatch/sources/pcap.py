"""Packets from field exports as TSV, and finding captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import int_or_null, or_null
from .captures import listed

#: The export's columns, in order.
TSV_FIELDS = ("frame_number", "frame_time_epoch", "ip_src", "ipv6_src", "ip_dst", "ipv6_dst", "tcp_srcport", "udp_srcport", "tcp_dstport", "udp_dstport", "protocol", "tcp_stream", "frame_len", "http_method", "http_uri", "http_status", "dns_query", "retransmission")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(pcap_path) of *.pcap and *.pcapng under a folder, sorted; an error if there are none."""
    found = listed(spark, folder).select("pcap_path").orderBy("pcap_path")
    if found.isEmpty():
        raise FileNotFoundError(f"no captures under {folder}")
    return found


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Packets of a TSV export; short rows are padded with nulls, rows without number or time go."""
    schema = ", ".join(f"{c} string" for c in TSV_FIELDS)
    x = spark.read.schema(schema).option("sep", "\t").option("quote", '"').option("mode", "PERMISSIVE").csv(path).withColumn("pcap_path", F.col("_metadata.file_path"))
    text = lambda *c: F.coalesce(*[or_null(F.col(n)) for n in c])
    number = lambda *c: F.coalesce(*[int_or_null(or_null(F.col(n))) for n in c])
    x = x.select(
        "pcap_path", F.col("frame_number").try_cast("long").alias("packet_number"), F.col("frame_time_epoch").try_cast("double").alias("packet_epoch"), text("ip_src", "ipv6_src").alias("src_ip"), number("tcp_srcport", "udp_srcport").alias("src_port"),
        text("ip_dst", "ipv6_dst").alias("dest_ip"), number("tcp_dstport", "udp_dstport").alias("dest_port"), text("protocol").alias("protocol"), or_null(F.col("tcp_stream")).try_cast("long").alias("tcp_stream"), or_null(F.col("frame_len")).try_cast("long").alias("frame_length"),
        text("http_method").alias("http_method"), text("http_uri").alias("http_uri"), number("http_status").alias("http_status"), text("dns_query").alias("dns_query"), F.lower(F.coalesce(text("retransmission"), F.lit(""))).isin("1", "true").alias("is_retransmission"),
    ).where("packet_number is not null and packet_epoch is not null")
    return with_micros(x)


def with_micros(packets: DataFrame) -> DataFrame:
    return packets.withColumn("packet_us", F.round(F.col("packet_epoch") * 1_000_000).cast("long"))
