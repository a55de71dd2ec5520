"""Registered queries over captures: every event becomes a packet, captures of a day are written and read back."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evidence
from ..sources import adapter, captures
from ..sources.tables import shared_folder, stored

#: Columns of a packet as SQL that both engines understand, from id and us of events.
TURNED = "id % 5 = 0"
FIELDS = {
    "one": "concat('10.0.0.', cast(id % 4 as varchar(9)))", "other": "concat('192.168.0.', cast(id % 3 as varchar(9)))", "tcp": "id % 7 <> 0", "port_one": "cast(4000 + id % 2 as int)",
    "port_other": "cast(case when id % 7 <> 0 then 80 when id % 2 = 0 then 53 else 9000 end as int)", "flags": f"case when id % 11 = 0 and id % 5 <> 0 then 2 else 16 end", "seq": "(4294960000 + (id - id % 6) * 13) % 4294967296",
}
SPLIT = 1 << 14


def _frames(batches):
    """(pcap_path, packet_number, packet_ns, link, length, frame) as Ethernet frames."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            ends = [bytes(map(int, ip.split("."))) for ip in (r.one, r.other)]
            ports, turn = [r.port_one, r.port_other], -1 if r.id % 5 == 0 else 1
            if r.tcp:
                kind, i = 6, r.id % 100
                payload = b"" if r.flags == 2 else (f"GET /p/{i} HTTP/1.1\r\n\r\n".encode(), f"HTTP/1.1 {200 + r.id % 5} OK\r\n\r\n".encode(), b"x" * (r.id % 50), b"")[r.id % 4]
                body = struct.pack(">HHIIBBHHH", *ports[::turn], r.seq, 0, 5 << 4, r.flags, 1000, 0, 0) + payload
            else:
                kind, host = 17, f"h{r.id % 20}".encode()
                query = struct.pack(">HHHHHH", 1, 256, 1, 0, 0, 0) + bytes([len(host)]) + host + b"\x07example\x00" + struct.pack(">HH", 1, 1)
                payload = query if r.port_other == 53 else b"y" * 5
                body = struct.pack(">HHHH", *ports[::turn], 8 + len(payload), 0) + payload
            ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, kind, 0) + b"".join(ends[::turn]) + body
            frame = bytes(12) + b"\x08\x00" + ip
            out.append((r.day, r.number, r.us * 1000, 1, len(frame), frame))
        yield pd.DataFrame(out, columns=["pcap_path", "packet_number", "packet_ns", "link", "length", "frame"])


def _written(spark, sf_dir) -> str:
    """A folder with a capture for each day of events."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex[:12]}"
    x = adapter.events(spark, sf_dir).select("id", "us", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day"))
    x = x.withColumn("number", F.row_number().over(Window.partitionBy("day").orderBy("us", "id"))).selectExpr("id", "us", "day", "number", *[f"{e} as {c}" for c, e in FIELDS.items()])
    frames = x.mapInPandas(_frames, "pcap_path string, packet_number long, packet_ns long, link int, length long, frame binary")
    captures.write_captures(frames.withColumn("case_id", F.lit("eth0")), folder)
    return folder


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.regexp_extract("pcap_path", r"(\d{4}-\d{2}-\d{2})", 1))


def capture_packets(spark, sf_dir):
    """All fields of all packets, read in ranges smaller than a capture."""
    got = captures.packets(captures.listed(spark, _written(spark, sf_dir)), SPLIT)
    return _day(got).drop("pcap_path", "packet_epoch")


def dated_captures(spark, sf_dir):
    """Packets of the captures that cases of every third day of the month need; others stay closed."""
    files = captures.listed(spark, _written(spark, sf_dir))
    days = adapter.events(spark, sf_dir).select(F.date_trunc("day", F.timestamp_micros("us")).alias("d")).distinct().where(F.dayofmonth("d") % 3 == 0)
    cases = days.select(F.date_format("d", "yyyyMMdd").alias("case_id"), F.unix_micros("d").alias("first_us"))
    needed = evidence.needed_captures(files, evidence.capture_assignment(cases, files))
    return _day(captures.packets(needed)).groupBy("day").agg(F.count("*").alias("packets"), F.sum("frame_length").alias("bytes"))


def case_captures(spark, sf_dir):
    """Packets of three cases, exported in one pass over the captures and read back."""
    folder = _written(spark, sf_dir)
    files = stored(captures.listed(spark, folder), "files")
    numbers = captures.packets(files).select("pcap_path", "packet_number").where("packet_number % 5 <> 0")
    rows = numbers.select(F.concat(F.lit("CASE-"), (F.col("packet_number") % 3).cast("string")).alias("case_id"), "pcap_path", "packet_number")
    captures.export_cases(rows, files, f"{folder}-export", SPLIT)
    got = _day(captures.packets(captures.listed(spark, f"{folder}-export")))
    return got.select(F.regexp_extract("pcap_path", r"(CASE-\d)__", 1).alias("case_id"), "day", "packet_number", "packet_us", "src_ip", "dest_port", "frame_length")


QUERIES = [capture_packets, dated_captures, case_captures]

W_PACKETS = f"""ev as (select id, us, strftime(make_timestamp(us), '%Y-%m-%d') as day from ({adapter.SQL})),
pk as (select id, us, day, row_number() over (partition by day order by us, id) as packet_number, {", ".join(f"{e} as {c}" for c, e in FIELDS.items())} from ev),
sz as (select *, case when not tcp then case when port_other = 53 then 12 + 1 + length('h' || id % 20) + 9 + 4 else 5 end when flags = 2 then 0
  when id % 4 = 0 then 7 + length((id % 100)::varchar) + 13 when id % 4 = 1 then 19 when id % 4 = 2 then id % 50 else 0 end as payload from pk),
ln as (select *, 14 + 20 + (case when tcp then 20 else 8 end) + payload as frame_length, payload + (case when flags = 2 then 1 else 0 end) as span, case when tcp then 6 else 17 end as ip from sz)"""
W_STREAMS = W_PACKETS + f""",
op as (select *, last_value(case when flags = 2 then seq end ignore nulls) over (w rows between unbounded preceding and 1 preceding) as opened, row_number() over w as k from ln where tcp window w as (partition by day, one, other, port_one order by packet_number)),
bg as (select *, k = 1 or flags = 2 and seq is distinct from opened as begins from op),
cn as (select *, max(case when begins then packet_number end) over (partition by day, one, other, port_one order by packet_number) as begun from bg),
st as (select *, dense_rank() over (partition by day order by begun) - 1 as stream from cn),
ps as (select *, coalesce((seq - lag(seq) over d + 6442450944) % 4294967296 - 2147483648, 0) as step from st window d as (partition by day, begun, {TURNED} order by packet_number)),
po as (select *, sum(step) over (partition by day, begun, {TURNED} order by packet_number) as pos from ps),
re as (select *, max(case when span > 0 then {{'t': pos + span, 'a': -us}} end) over (partition by day, begun, {TURNED} order by packet_number rows between unbounded preceding and 1 preceding) as top from po),
ag as (select day, packet_number, stream, span > 0 and coalesce(pos < top.t and us + top.a >= 3000 and not (span <= 1 and flags <> 2 and pos = top.t - 1), false) as again from re)"""


def oracle_sql() -> dict[str, str]:
    end = lambda a, b: f"case when {TURNED} then {b} else {a} end"
    plain = "tcp and flags <> 2 and id % 4"
    return {
        "capture_packets": f"""with {W_STREAMS} select day, packet_number, us as packet_us, {end("one", "other")} as src_ip, {end("port_one", "port_other")} as src_port, {end("other", "one")} as dest_ip, {end("port_other", "port_one")} as dest_port,
  case when {plain} <= 1 then 'HTTP' when tcp then 'TCP' when port_other = 53 then 'DNS' else 'UDP' end as protocol, stream::bigint as tcp_stream, frame_length::bigint as frame_length, case when {plain} = 0 then 'GET' end as http_method,
  case when {plain} = 0 then '/p/' || id % 100 end as http_uri, case when {plain} = 1 then (200 + id % 5)::int end as http_status, case when not tcp and port_other = 53 then 'h' || id % 20 || '.example' end as dns_query, coalesce(again, false) as is_retransmission
  from ln left join ag using (day, packet_number)""",
        "dated_captures": f"with {W_PACKETS} select day, count(*) as packets, sum(frame_length)::bigint as bytes from ln where day(day::date) % 3 = 0 group by day",
        "case_captures": f"""with {W_PACKETS} select 'CASE-' || packet_number % 3 as case_id, day, row_number() over (partition by packet_number % 3, day order by packet_number) as packet_number, us as packet_us, {end("one", "other")} as src_ip,
  {end("port_other", "port_one")} as dest_port, frame_length::bigint as frame_length from ln where packet_number % 5 <> 0""",
    }
