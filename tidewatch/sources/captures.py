"""Captures, classic and next-generation, read by byte ranges.

A capture has no index, so a range that begins inside a file looks for the first
offset from which a chain of plausible records leads on. Every range reports
where its records begin and end and how many there are; a begin that isn't the
end of the range before was a false one (a capture inside a payload), and the
range is read again from the right place. Counts give each range the number of
its first packet, so packets have the numbers of a serial read.

Captures are a DataFrame of paths and sizes: what a filter or a semi-join leaves
out is never opened. Connections and retransmissions are found by windows over
blocks of packets, with what lies before a block as one row per block, so that a
connection with most of a capture's packets is spread.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from ..schemas import PACKETS
from .frames import ACK, FIN, SYN, decode_frame
from .tables import stored

SPLIT, BLOCK, SALTS, TASKS = 32 << 20, 65_536, 16, 4
CHAIN, LIMIT = 8, 1 << 26
#: Magic numbers with byte order and ticks a second; block types; time from which a late packet counts as sent again.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
SECTION, INTERFACE, OBSOLETE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
BLOCK_TYPES = {SECTION, INTERFACE, OBSOLETE, SIMPLE, 4, 5, ENHANCED, 9, 10, 0xBAD, 0x40000BAD}
REORDERED_US = 3000
RANGE = "pcap_path string, size long, range int, begin long, stop long"
MARKS = "array<struct<at: long, order: string, link: int, resolution: int, shift: long, snap: long>>"
INDEX = f"{RANGE}, first long, last long, packets long, marks {MARKS}"
EXTRA = "tcp_seq long, tcp_flags int, tcp_length int, packet_ns long, link int"


def open_file(path: str):
    """A random-access file; file: and s3a: paths as Spark writes them."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)
    return system.open_input_file(at)


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """(pcap_path, size) of capture files, and of *.pcap and *.pcapng below folders; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pcap,pcapng}").load(list(paths))
    return found.select(F.col("path").alias("pcap_path"), F.col("length").alias("size")).distinct()


class _Bytes:
    """Bytes of a file, held from `begin` on and fetched further as they are asked for."""

    def __init__(self, f, size: int, begin: int, end: int) -> None:
        self.f, self.size, self.begin = f, size, begin
        self.held = f.read_at(max(0, min(end, size) - begin), begin)

    def get(self, at: int, n: int) -> bytes | None:
        if n < 0 or at + n > self.size:
            return None
        if at < self.begin:
            return self.f.read_at(n, at)
        if (lack := at + n - self.begin - len(self.held)) > 0:
            self.held += self.f.read_at(min(self.size - self.begin - len(self.held), max(lack, 1 << 16)), self.begin + len(self.held))
        return self.held[at - self.begin : at - self.begin + n]


class Classic:
    """Walks the records of a classic capture."""

    def __init__(self, head: bytes) -> None:
        self.order, self.unit = CLASSIC[head[:4]]
        self.link = struct.unpack(f"{self.order}I", head[20:24])[0] & 0xFFFF if len(head) >= 24 else 1
        self.record, self.start, self.marks = struct.Struct(f"{self.order}IIII"), 24, []

    def walk(self, src: _Bytes, at: int, stop: int) -> Iterator[tuple]:
        """(ns, length, link, offset of the frame, its size) of records that begin before stop; self.end is where the next one begins."""
        while at < stop:
            if (h := src.get(at, 16)) is None:
                at = src.size
                break
            sec, frac, size, length = self.record.unpack(h)
            if at + 16 + size > src.size:
                at = src.size
                break
            yield sec * 10**9 + frac * (10**9 // self.unit), length, self.link, at + 16, size
            at += 16 + size
        self.end = at

    def plausible(self, src: _Bytes, at: int) -> bool:
        before = None
        for _ in range(CHAIN):
            if at == src.size:
                return before is not None
            if (h := src.get(at, 16)) is None:
                return False
            sec, frac, size, length = self.record.unpack(h)
            if frac >= self.unit or size > length or length > LIMIT or before is not None and abs(sec - before) > 86_400 or at + 16 + size > src.size:
                return False
            at, before = at + 16 + size, sec
        return True


class NextGeneration:
    """Walks the blocks of a next-generation capture; marks note sections and interfaces by offset."""

    def __init__(self, head: bytes, marks: list[dict] = ()) -> None:
        self.order, self.start, self.marks, self.links = ORDERS.get(head[8:12], "<"), 0, [], []
        self.found = self.order
        for m in marks:
            self._mark(m)
        self.marks = []

    def _mark(self, m: dict) -> None:
        self.marks.append(m)
        if m["link"] < 0:
            self.order, self.links = m["order"], []
        else:
            self.links.append(m)

    def walk(self, src: _Bytes, at: int, stop: int) -> Iterator[tuple]:
        while at < stop:
            if (h := src.get(at, 12)) is None:
                at = src.size
                break
            if h[:4] == b"\x0a\x0d\x0d\x0a":
                self._mark({"at": at, "order": ORDERS.get(h[8:12], self.order), "link": -1, "resolution": 0, "shift": 0, "snap": 0})
            kind, total = struct.unpack(f"{self.order}II", h[:8])
            if total < 12 or at + total > src.size:
                at = src.size
                break
            if kind == INTERFACE:
                self._mark(self._interface(src.get(at + 8, total - 12), at))
            elif kind in (ENHANCED, OBSOLETE, SIMPLE):
                yield self._packet(kind, src.get(at + 8, min(20, total - 12)), at, total)
            at += total
        self.end = at

    def _interface(self, body: bytes, at: int) -> dict:
        found, opt = {"at": at, "order": self.order, "link": struct.unpack_from(f"{self.order}H", body)[0], "resolution": 6, "shift": 0, "snap": struct.unpack_from(f"{self.order}I", body, 4)[0]}, 8
        while opt + 4 <= len(body):
            code, size = struct.unpack_from(f"{self.order}HH", body, opt)
            if code == 9 and size:
                found["resolution"] = body[opt + 4]
            if code == 14 and size == 8:
                found["shift"] = struct.unpack_from(f"{self.order}q", body, opt + 4)[0]
            if code == 0:
                break
            opt += 4 + (size + 3) // 4 * 4
        return found

    def _packet(self, kind: int, h: bytes, at: int, total: int) -> tuple:
        if kind == SIMPLE:  # no time; the first interface limits what is stored
            length = struct.unpack_from(f"{self.order}I", h)[0]
            snap = self.links[0]["snap"] if self.links else 0
            return None, length, self.links[0]["link"] if self.links else -1, at + 12, min(length, snap or length, total - 16)
        which, high, low, size, length = struct.unpack(f"{self.order}IIIII" if kind == ENHANCED else f"{self.order}HxxIIII", h)
        if which >= len(self.links):  # an index is made without what came before
            return None, length, -1, at + 28, min(size, total - 32)
        own = self.links[which]
        ticks, res = (high << 32) + low, own["resolution"]
        ns = ticks * 10**9 >> (res & 127) if res & 128 else ticks * 10**9 // 10**res
        return ns + own["shift"] * 10**9, length, own["link"], at + 28, min(size, total - 32)

    def plausible(self, src: _Bytes, at: int) -> bool:
        return any(self._chain(src, at, order) for order in (self.order, "<>"[self.order == "<"]))

    def _chain(self, src: _Bytes, at: int, order: str) -> bool:
        for k in range(CHAIN):
            if at == src.size:
                return k > 0
            if (h := src.get(at, 12)) is None:
                return False
            if h[:4] == b"\x0a\x0d\x0d\x0a":
                order = ORDERS.get(h[8:12], order)
            kind, total = struct.unpack(f"{order}II", h[:8])
            if kind not in BLOCK_TYPES or total % 4 or not 12 <= total <= LIMIT or (tail := src.get(at + total - 4, 4)) is None or struct.unpack(f"{order}I", tail)[0] != total:
                return False
            if k == 0:
                self.found = order
            at += total
        return True


def walker(f, marks: list[dict] = ()):
    """A walker for an open file by its first bytes; None if it is no capture."""
    head = f.read_at(24, 0)
    if head[:4] in CLASSIC:
        return Classic(head)
    return NextGeneration(head, marks) if head[:4] == b"\x0a\x0d\x0d\x0a" else None


def _index(pdf_rows):
    for pdf in pdf_rows:
        out = []
        for r in pdf.itertuples(index=False):
            with open_file(r.pcap_path) as f:
                walk = walker(f)
                if walk is None:
                    raise ValueError(f"not a capture file: {r.pcap_path}")
                src, at = _Bytes(f, r.size, r.begin, r.stop), r.forced
                if at < 0:
                    at, step = max(r.begin, walk.start), 1 if isinstance(walk, Classic) else 4
                    at += -at % step
                    while r.begin and at < r.stop and not walk.plausible(src, at):
                        at += step
                elif isinstance(walk, NextGeneration):
                    walk.plausible(src, at)
                if r.begin and isinstance(walk, NextGeneration):
                    walk.order = walk.found
                n = sum(1 for _ in walk.walk(src, at, r.stop)) if at < r.stop else 0
                first, last = (at, walk.end) if at < r.stop else (-1, -1)
                out.append((r.pcap_path, r.size, r.range, r.begin, r.stop, first, last, n, walk.marks))
        yield pd.DataFrame(out, columns=["pcap_path", "size", "range", "begin", "stop", "first", "last", "packets", "marks"])


def indexed(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The byte ranges of captures: where each one's records begin and end, how many packets it has and the number of its first one."""
    spark = files.sparkSession
    ranges = files.withColumn("range", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / split).cast("int") - 1))))
    ranges = ranges.select("pcap_path", "size", "range", (F.col("range").cast("long") * split).alias("begin"), F.least("size", (F.col("range") + 1).cast("long") * split).alias("stop"))
    made = _read_index(ranges.withColumn("forced", F.lit(-1).cast("long")))
    order = Window.partitionBy("pcap_path").orderBy("range")  # a row per range of a file
    while True:
        before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
        due = F.when(F.col("range") == 0, F.col("first")).otherwise(F.when(before < F.col("stop"), before).otherwise(-1))
        held = made.withColumn("_due", due)
        # one wrong begin may have made those behind it wrong: only the first of a file is sure to be read from the right place
        wrong = held.where(F.col("first") != F.col("_due"))
        if wrong.isEmpty():
            break
        first = wrong.groupBy("pcap_path").agg(F.min("range").alias("range"))
        redo = wrong.join(first, ["pcap_path", "range"])
        none = redo.where("_due < 0").select("pcap_path", "size", "range", "begin", "stop", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("packets"), F.array().cast(MARKS).alias("marks"))
        again = _read_index(redo.where("_due >= 0").select("pcap_path", "size", "range", "begin", "stop", F.col("_due").alias("forced")))
        made = stored(made.join(first, ["pcap_path", "range"], "left_anti").unionByName(none).unionByName(again), "captures")
    ahead = F.coalesce(F.sum("packets").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    # interfaces are few, and each range needs those before it
    marks = F.filter(F.flatten(F.collect_list("marks").over(Window.partitionBy("pcap_path"))), lambda m: m["at"] < F.col("first"))
    out = made.select("pcap_path", "size", "range", "begin", "stop", "first", "last", "packets", ahead.alias("number"), F.array_sort(marks).alias("marks"))
    return out.where("packets > 0")


def _read_index(ranges: DataFrame) -> DataFrame:
    return stored(_spread(stored(ranges, "captures")).mapInPandas(_index, INDEX), "captures")


def _walked(r: dict):
    """(number, ns, length, link, frame) of a range's packets."""
    with open_file(r["pcap_path"]) as f:
        walk, src = walker(f, r["marks"]), _Bytes(f, r["size"], r["first"], r["stop"])
        for k, (ns, length, link, at, size) in enumerate(walk.walk(src, r["first"], r["stop"])):
            yield r["number"] + k, ns, length, link, src.get(at, size)


def _decoded(schema: pa.Schema):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = []
                for number, ns, length, link, frame in _walked(r):
                    d = decode_frame(frame, link)
                    rows.append((r["pcap_path"], number, None if ns is None else ns / 1e9, d.src_ip, d.src_port, d.dest_ip, d.dest_port, d.protocol, None, length, d.http_method, d.http_uri, d.http_status, d.dns_query, False, d.tcp_seq, d.tcp_flags, d.tcp_length, ns, link))
                    if len(rows) == 8192:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _spread(index: DataFrame) -> DataFrame:
    """Ranges dealt to tasks of SPLIT bytes each, or to a few for each core if there are less: ranges are large and their rows small, and a task for each small one would cost more than its bytes."""
    n, size = index.agg(F.count("*"), F.sum(F.col("stop") - F.col("begin"))).first()
    tasks = max(min(n, TASKS * index.sparkSession.sparkContext.defaultParallelism), -(-(size or 0) // SPLIT))
    return index.repartition(max(1, min(n, tasks, 100_000)), "pcap_path", "range")


def packets(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Packets of captures (pcap_path, size), with the fields of an export and packet_us; numbers, connections and retransmissions are those of each whole file."""
    ddl = f"{PACKETS}, {EXTRA}"
    raw = stored(_spread(stored(indexed(files, split), "captures")).mapInArrow(_decoded(_arrow(ddl)), ddl), "packets")
    return with_connections(raw.withColumn("packet_us", F.expr("packet_ns div 1000")))


def _signed(difference: Column) -> Column:
    """A difference of sequence numbers, modulo 2^32, between -2^31 and 2^31."""
    return F.pmod(difference + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def with_connections(raw: DataFrame) -> DataFrame:
    """Packets with tcp_stream and is_retransmission.

    Connections are numbered from 0 in the order of their first packets in a
    capture. A pair of ends begins a new one with a SYN whose sequence number
    differs from the last SYN's that wasn't an answer. A packet with data, SYN or
    FIN is a retransmission if it begins before the greatest sequence number
    that its direction had reached, unless it is a keep-alive or comes less than
    3 ms after the packet that reached it (then it was only late).
    """
    ends = [F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")) for s in ("src", "dest")]
    tcp = raw.where("tcp_seq is not null").select(
        "pcap_path", "packet_number", "packet_us", F.least(*ends).alias("one"), F.greatest(*ends).alias("other"), (ends[0] <= ends[1]).alias("forth"), "tcp_seq", "tcp_length",
        F.col("tcp_flags").bitwiseAND(SYN | ACK).alias("_syn"), (F.col("tcp_length") + F.when(F.col("tcp_flags").bitwiseAND(SYN) != 0, 1).otherwise(0) + F.when(F.col("tcp_flags").bitwiseAND(FIN) != 0, 1).otherwise(0)).cast("long").alias("_span"),
        F.floor(F.col("packet_number") / BLOCK).cast("long").alias("_block"),
    )
    pair = ["pcap_path", "one", "other"]
    opening = F.when(F.col("_syn") == SYN, F.col("tcp_seq"))
    x = _before(tcp, pair, {"_opened": ("last", opening), "_seen": ("max", F.col("packet_number"))})
    begins = F.col("_seen").isNull() | F.coalesce(opening != F.coalesce(F.col("_opened"), F.lit(-1)), F.lit(False))
    x = x.withColumn("_begins", F.when(begins, F.col("packet_number")))
    x = stored(_before(x, pair, {"_begun": ("max", F.col("_begins"))}).withColumn("_begun", F.coalesce("_begins", "_begun")), "connections")
    firsts = numbered(x.where("_begins is not null").select("pcap_path", F.col("_begins").alias("_begun")), "_stream", [F.floor(F.col("_begun") / BLOCK)], F.floor(F.col("_begun") / (BLOCK << 10)), [F.col("_begun")], within=("pcap_path",))
    # a connection may hold most packets: its number goes to every salt
    salted = firsts.select("pcap_path", "_begun", (F.col("_stream") - 1).alias("_stream"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    x = _sent_again(x).withColumn("_salt", F.pmod("_block", F.lit(SALTS))).join(salted, ["pcap_path", "_begun", "_salt"])
    marks = x.select(F.col("pcap_path").alias("_path"), F.col("packet_number").alias("_number"), "_stream", "_again")
    out = raw.join(marks, (F.col("pcap_path") == F.col("_path")) & (F.col("packet_number") == F.col("_number")), "left")
    return out.withColumns({"tcp_stream": F.col("_stream"), "is_retransmission": F.coalesce("_again", F.lit(False))}).drop("_path", "_number", "_stream", "_again", "tcp_seq", "tcp_flags", "tcp_length", "packet_ns", "link")


def _before(x: DataFrame, keys: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """x with the greatest, or the last that isn't null, of expressions over earlier packets of equal keys: inside a block, else by a row for each earlier block."""
    value = {f"{n}_v": e for n, (_, e) in columns.items()}
    x = x.withColumns(value)
    inside = Window.partitionBy(*keys, "_block").orderBy("packet_number").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda how, c, w: (F.max(c) if how == "max" else F.last(c, ignorenulls=True)).over(w)
    whole = x.groupBy(*keys, "_block").agg(*[(F.max(f"{n}_v") if how == "max" else F.max_by(f"{n}_v", F.when(F.col(f"{n}_v").isNotNull(), F.col("packet_number")))).alias(n) for n, (how, _) in columns.items()])
    whole = whole.select(*keys, "_block", *[over(how, n, above).alias(f"{n}_b") for n, (how, _) in columns.items()])
    x = x.withColumns({n: over(how, f"{n}_v", inside) for n, (how, _) in columns.items()}).join(whole, [*keys, "_block"])
    return x.withColumns({n: F.coalesce(n, f"{n}_b") for n in columns}).drop(*[f"{n}{s}" for n in columns for s in ("_v", "_b")])


def _sent_again(x: DataFrame) -> DataFrame:
    """x with _again; positions count bytes of a direction from its first packet on, so they don't wrap."""
    way = ["pcap_path", "one", "other", "_begun", "forth"]
    inside = Window.partitionBy(*way, "_block").orderBy("packet_number")
    x = x.withColumn("_step", F.coalesce(_signed(F.col("tcp_seq") - F.lag("tcp_seq").over(inside)), F.lit(0)))
    x = x.withColumn("_local", F.sum("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.when(F.col("_span") > 0, F.struct((F.col("_local") + F.col("_span")).alias("to"), (-F.col("packet_us")).alias("at")))
    x = x.withColumn("_reach", reach)
    ordered = lambda f, c: f(c, "packet_number")
    blocks = x.groupBy(*way, "_block").agg(ordered(F.min_by, "tcp_seq").alias("_head"), ordered(F.max_by, "tcp_seq").alias("_tail"), ordered(F.max_by, "_local").alias("_run"), F.max("_reach").alias("_top"))
    w = Window.partitionBy(*way).orderBy("_block")
    gap = F.coalesce(F.lag("_run").over(w) + _signed(F.col("_head") - F.lag("_tail").over(w)), F.lit(0))
    blocks = blocks.withColumn("_gap", gap).withColumn("_base", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.when(F.col("_top").isNotNull(), F.struct((F.col("_top.to") + F.col("_base")).alias("to"), F.col("_top.at").alias("at")))
    blocks = blocks.withColumn("_top", top).select(*way, "_block", "_base", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_top_before"))
    x = x.withColumn("_near", F.max("_reach").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(blocks, [*way, "_block"])
    near = F.when(F.col("_near").isNotNull(), F.struct((F.col("_near.to") + F.col("_base")).alias("to"), F.col("_near.at").alias("at")))
    most, start = F.greatest(near, F.col("_top_before")), F.col("_base") + F.col("_local")
    x = x.withColumn("_most", most)
    alive = (F.col("_span") <= 1) & (F.col("tcp_length") == F.col("_span")) & (start == F.col("_most.to") - 1)
    late = F.col("packet_us") + F.col("_most.at") < REORDERED_US
    return x.withColumn("_again", (F.col("_span") > 0) & F.coalesce((start < F.col("_most.to")) & ~alive & ~late, F.lit(False)))


# export ---------------------------------------------------------------------

FRAMES = "pcap_path string, packet_number long, packet_ns long, length long, link int, frame binary"
WRITTEN = "case_id string, pcap_path string, part long, file string, packets long"
PART = 1_000_000


def _picked(batches):
    schema = _arrow(FRAMES)
    for b in batches:
        for r in b.to_pylist():
            wanted, rows, held = set(r["wanted"]), [], 0
            for number, ns, length, link, frame in _walked(r):
                if number in wanted:
                    rows.append((r["pcap_path"], number, ns, length, link, frame))
                    held += len(frame)
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, schema)


def frames_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames of packets (pcap_path, packet_number): every range that holds one is read once, others aren't opened."""
    bucket = lambda c: F.floor(c / F.lit(BLOCK)).cast("long")
    spans = index.withColumn("_b", F.explode(F.sequence(bucket(F.col("number")), bucket(F.col("number") + F.col("packets") - 1)))).select("pcap_path", "_b", "range", "number", "packets")
    rows = wanted.select("pcap_path", "packet_number").distinct().withColumn("_b", bucket(F.col("packet_number")))
    met = rows.join(spans, ["pcap_path", "_b"]).where("packet_number >= number and packet_number < number + packets")
    # a range's packets are as few as its bytes allow
    lists = met.groupBy("pcap_path", "range").agg(F.collect_list("packet_number").alias("wanted"))
    return _spread(index.join(lists, ["pcap_path", "range"])).mapInArrow(_picked, FRAMES)


def block(kind: int, body: bytes) -> bytes:
    total = 12 + len(body) + -len(body) % 4
    return struct.pack("<II", kind, total) + body + bytes(-len(body) % 4) + struct.pack("<I", total)


HEAD = block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface_block(link: int) -> bytes:
    """An interface whose ticks are nanoseconds."""
    return block(INTERFACE, struct.pack("<HHI", link, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))


def packet_block(which: int, ns: int, length: int, frame: bytes) -> bytes:
    return block(ENHANCED, struct.pack("<IIIII", which, ns >> 32, ns & 0xFFFFFFFF, len(frame), length) + frame)


def _writes(folder: str):
    def run(batches):
        import hashlib
        import uuid

        from pyarrow import fs

        where = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else "s3://" + folder[6:] if folder.startswith("s3a://") else folder
        files, at = fs.FileSystem.from_uri(where)
        files.create_dir(at, recursive=True)
        state, schema = None, _arrow(WRITTEN)

        def close():
            state["out"].close()
            files.move(state["temporary"], f"{at}/{state['name']}")
            return _batch([(*state["key"], f"{folder}/{state['name']}", state["n"])], schema)

        for b in batches:
            for r in b.to_pylist():
                key = (r["case_id"], r["pcap_path"], r["part"])
                if state is None or state["key"] != key:
                    if state:
                        yield close()
                    name = f"{r['case_id']}__{PurePosixPath(r['pcap_path']).stem}-{hashlib.sha1(r['pcap_path'].encode()).hexdigest()[:8]}" + (f"-{r['part']}" if r["part"] else "") + ".pcapng"
                    temporary = f"{at}/_{uuid.uuid4().hex}"
                    state = {"key": key, "name": name, "temporary": temporary, "out": files.open_output_stream(temporary, compression=None), "links": {}, "n": 0}
                    state["out"].write(HEAD)
                out, links = state["out"], state["links"]
                if r["link"] not in links:
                    links[r["link"]] = len(links)
                    out.write(interface_block(r["link"]))
                out.write(packet_block(links[r["link"]], r["packet_ns"] or 0, r["length"], r["frame"]))
                state["n"] += 1
        if state:
            yield close()

    return run


def write_captures(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (case_id, pcap_path, packet_number and the columns of frames) as next-generation captures: a file for a case and a source capture, and for each million packets' numbers beyond the first. Returns (case_id, pcap_path, part, file, packets).

    Files are streamed in order of packet numbers and renamed once whole, so a repeated task writes the same file again.
    """
    parted = rows.withColumn("part", F.floor(F.col("packet_number") / PART).cast("long"))
    dealt = parted.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_id", "pcap_path", "part").sortWithinPartitions("case_id", "pcap_path", "part", "packet_number")
    return stored(dealt.select("case_id", "pcap_path", "part", "packet_number", "packet_ns", "length", "link", "frame").mapInArrow(_writes(folder), WRITTEN), "exports").orderBy("case_id", "pcap_path", "part")


def export_cases(evidence_rows: DataFrame, files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """Writes each case's packets out of captures (pcap_path, size); one pass over the captures that hold any, for all cases together."""
    named = evidence_rows.select("case_id", "pcap_path", "packet_number").distinct()
    index = stored(indexed(files.join(named.select("pcap_path").distinct(), "pcap_path", "left_semi"), split), "captures")
    return write_captures(named.join(frames_of(index, named), ["pcap_path", "packet_number"]), folder)
