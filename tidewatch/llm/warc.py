"""Deterministic sharded WARC writer and reader.

Writing
  1. Records are ordered by page id, digest and a hash of the url. Prefix sums of
     their sizes (payload, url and HEADER_BYTES, so that empty pages count too)
     over that order, taken range by range, cut it into shards of SHARD_BYTES; a
     border is a page id, the first 60 bits of a digest and the hash of a url. So
     shards depend on the rows alone, not on partitions or timing, and hold equal
     shares however ids are spread; only rows that are equal in all three stay
     together. A border takes 24 bytes for SHARD_BYTES of records (75 MB for 100
     TB), as Arrow columns, and there are at most MOST_SHARDS (96 MB); beyond 128
     TB shards grow.
  2. Revisits are found on digests alone: of equal payloads of at least
     REVISIT_BYTES the largest id is the response, the others get a small
     marker row.
  3. Rows and markers are dealt by range of shards and sorted; a task streams
     its shards, one gzip member a record, and rolls to a new file when the
     compressed size passes ROLL_BYTES. Record ids and dates are derived from
     the content, so equal tables give equal bytes.
  4. Files are written under temporary names that hold the task attempt; the
     task's manifest rows name them. Only files of successful attempts are in
     the manifest. Tasks rename these, each as often as it is retried with one
     outcome, and the driver puts the manifest in place last; readers trust the
     manifest, so a lost executor or an aborted job leaves nothing visible.

Reading checks every record's block and payload digest and resolves revisits to
the payload facts stated in their headers.

Defined cases: null payloads count as empty; null ids come first, are written
with an empty id and are responses unless a row with an id has the same long
payload; rows that share the largest id of a payload are each responses;
other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, scratch, shuffle_partitions, written

MOST_SHARDS, MOST_TASKS = 1 << 22, 1 << 17
SHARD_BYTES, ROLL_BYTES, REVISIT_BYTES, HEADER_BYTES = 32 << 20, 8 << 20, 1000, 700
DATE = "1970-01-01T00:00:00Z"  # no capture date is known; a fixed one keeps files reproducible
CRLF, STEP = b"\r\n", 1 << 14
MANIFEST = "shard long, seq int, name string, temporary string, bytes long, records long, sha256 string"


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response of page refers_to; headers are made from the payload."""
    digest, name = sha1_32(payload), "" if page_id is None else page_id
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=UTF-8", b"Content-Length: %d" % len(payload), b"", b""])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id("revisit" if revisit else "response", name, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(url.split()) or "urn:none"), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_32(block)), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", name), ("X-Payload-Length", len(payload)),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("response", refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    head.append(("Content-Length", len(block)))
    lines = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return lines + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without time or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_records(data: bytes):
    """Headers and block of every record of a .warc.gz file; raises on damaged digests."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(data):  # in steps, as what follows a member is copied
            parts.append(d.decompress(view[at : at + STEP]))
            at += STEP
        raw = b"".join(parts) + d.flush()
        at = min(at, len(data)) - len(d.unused_data)
        head, _, rest = raw.partition(CRLF + CRLF)
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if sha1_32(block) != fields["WARC-Block-Digest"] or rest[len(block) :] != CRLF + CRLF:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        yield fields, block


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri}")


class _Roller:
    """Streams one shard to files of about a size; remembers what it wrote."""

    def __init__(self, root: str, attempt: str, shard: int, roll: int) -> None:
        self.fs, self.root = _filesystem(root)
        self.attempt, self.shard, self.roll, self.made, self.out = attempt, shard, roll, [], None

    def write(self, member: bytes) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.made):04d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{name}"
            self.out, self.name, self.bytes, self.records, self.hash = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), name, 0, 0, hashlib.sha256()
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.made.append((self.shard, len(self.made), self.name, self.temporary, self.bytes, self.records, self.hash.hexdigest()))
            self.out = None


def _writer(root: str, roll: int):
    def run(batches):
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        roller, marked = None, None
        for pdf in batches:
            done = []
            for shard, page_id, is_null, url, html, refers_to, digest in zip(*(pdf[c] for c in ("shard", "page_id", "is_null", "url", "html", "refers_to", "digest")), strict=True):
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.made
                    roller, marked = _Roller(root, attempt, int(shard), roll), None
                key = None if is_null else int(page_id)
                if not pd.isna(refers_to):
                    marked = (key, digest, int(refers_to))
                    continue
                payload = html.encode("utf-8", "replace")
                refers = marked[2] if marked and marked[:2] == (key, digest) and len(payload) >= REVISIT_BYTES else None
                roller.write(gzip_member(build_record(key, url, payload, refers)))
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        if roller:
            roller.close()
            yield pd.DataFrame(roller.made, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def _committer(root: str):
    def run(batches):
        from pyarrow import fs

        files, at = _filesystem(root)
        for pdf in batches:
            for temporary, name, size in zip(pdf["temporary"], pdf["name"], pdf["bytes"], strict=True):
                if files.get_file_info(f"{at}/{temporary}").type == fs.FileType.File:
                    files.move(f"{at}/{temporary}", f"{at}/{name}")
                elif files.get_file_info(f"{at}/{name}").size != size:  # an earlier attempt has moved it, or it is lost
                    raise OSError(f"can't commit {name}")
            yield pdf[["name"]]

    return run


KEY = ("page_id", "h", "u")


def shard_borders(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """Page id, digest number and url hash of the first record of every shard but the first, from rows (page_id, h, u, bytes)."""
    spark, order = rows.sparkSession, [F.asc_nulls_first("page_id"), "h", "u"]
    sums = rows.groupBy(*KEY).agg(F.sum("bytes").alias("bytes"))
    placed = written(sums.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "warc-sizes")
    parts = sorted(placed.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect())
    total = sum(r["bytes"] for r in parts)
    each = max(shard_bytes, -(-total // MOST_SHARDS))
    ahead, offsets = 0, []
    for r in parts:
        offsets.append((r["part"], ahead))
        ahead += r["bytes"]
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy(*order)) - F.col("bytes")
    known = F.broadcast(spark.createDataFrame(offsets, "part int, ahead long"))  # a row for each shuffle partition
    shard = F.floor((F.col("ahead") + before) / F.lit(each)).alias("shard")
    least = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")).alias("page_id")
    first = placed.join(known, "part").select(least, "h", "u", shard).groupBy("shard").agg(F.min(F.struct(*KEY)).alias("f")).where("shard > 0")
    found = first.select("f.*").toArrow()
    discard(placed)
    made = np.array([found.column(c).to_numpy() for c in KEY], np.int64).reshape(3, -1)
    return made[:, np.lexsort(made[::-1])]


def _shard_of(borders: np.ndarray):
    """Shards from that of (page_id, h, low) to that of (page_id, h, high), as first and last."""

    def place(key: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
        ids, hs, us = borders
        low, high = np.searchsorted(ids, key), np.searchsorted(ids, key, "right")
        for k in np.flatnonzero(high > low):  # borders inside one page id are told apart by digests, and then by urls
            a, b = low[k] + np.searchsorted(hs[low[k] : high[k]], h[k]), low[k] + np.searchsorted(hs[low[k] : high[k]], h[k], "right")
            low[k] = a + np.searchsorted(us[a:b], u[k], "right")
        return low

    @F.pandas_udf("struct<first: long, last: long>")
    def shards(page_id: pd.Series, h: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"first": place(page_id.to_numpy(), h.to_numpy(), low.to_numpy()), "last": place(page_id.to_numpy(), h.to_numpy(), high.to_numpy())})

    return shards


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id long, url, html) under root; returns the manifest as reread."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("h")
    sized = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes"), F.xxhash64("url").alias("u"), (F.octet_length("html") + F.octet_length("url") + HEADER_BYTES).cast("long").alias("whole"))
    borders = shard_borders(sized.select("page_id", number, "u", F.col("whole").alias("bytes")), shard_bytes)

    long = sized.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest")
    last = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    marks = long.distinct().join(last, "digest").where("page_id is null or page_id <> refers_to")
    markers = marks.select("page_id", F.lit("").alias("url"), F.lit("").alias("html"), "digest", "refers_to")
    records = rows.select("page_id", "url", "html", F.sha1("html").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    # null ids come first: they take the least number, which no other row is cut from by a border within it
    key = F.coalesce("page_id", F.lit(-(1 << 63)).cast("long"))
    # a marker goes to every shard that holds its page's records of equal payload, and comes before them
    mark, url = F.col("refers_to").isNotNull(), F.xxhash64("url")
    low, high = (F.when(mark, F.lit(v).cast("long")).otherwise(url) for v in (-(1 << 63), (1 << 63) - 1))
    dealt = markers.unionAll(records).withColumns({"is_null": F.col("page_id").isNull(), "page_id": key}).withColumn("s", _shard_of(borders)("page_id", number, low, high))
    dealt = dealt.withColumn("shard", F.explode(F.sequence("s.first", "s.last"))).drop("s")
    ordered = dealt.repartitionByRange(min(borders.shape[1] + 1, MOST_TASKS), "shard").sortWithinPartitions("shard", "page_id", F.desc("is_null"), "digest", F.desc_nulls_last("refers_to"), "url")
    jfs, path = _hadoop(spark, root)
    jfs.mkdirs(path(f"{root}/_temporary"))
    ordered.select("shard", "page_id", "is_null", "url", "html", "refers_to", "digest").mapInPandas(_writer(root, roll_bytes), MANIFEST).write.parquet(f"{root}/_staged")
    staged = spark.read.schema(MANIFEST).parquet(f"{root}/_staged").select("temporary", "name", "bytes")
    staged.repartition(shuffle_partitions(spark), "name").mapInPandas(_committer(root), "name string").write.format("noop").mode("overwrite").save()
    if not jfs.rename(path(f"{root}/_staged"), path(f"{root}/_manifest")):
        raise OSError("can't commit the manifest")
    jfs.delete(path(f"{root}/_temporary"), True)
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def _hadoop(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _reader(batches):
    for pdf in batches:
        for content in pdf["content"]:
            out = []
            for fields, block in parse_records(bytes(content)):
                revisit = fields["WARC-Type"] == "revisit"
                payload = None if revisit else block.partition(CRLF + CRLF)[2]
                if payload is not None and sha1_32(payload) != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                out.append((number("X-Page-ID"), number("X-Payload-Length") if revisit else len(payload), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID"), fields["WARC-Target-URI"]))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """A row per record of the committed files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(root).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    committed = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").select("name")
    return files.join(committed, "name", "left_semi").select("content").mapInPandas(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_report(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    write_archives(pages, root)
    return read_archives(spark, root).drop("url")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from last then last end as refers_to
from m
"""
