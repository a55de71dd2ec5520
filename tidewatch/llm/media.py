"""Media columns: documents as interleaved sequences of text and media references.

``parse_sequence`` turns an HTML document into ordered items, each a text block
or a reference to a payload by its SHA-256 digest, with position and caption.
``interleave`` joins the references with a media store by digest, in a small
join: the store side is one row of decoded properties per digest, the payloads
themselves stay in the store. Items keep their positions and captions whether
or not their payload is found (resolved is then false).

Stored form: PNG, 8-bit RGB, 64 pixels a row, so one row is 192 samples. A
payload of whole rows survives losslessly.

Defined cases: null html or text counts as empty; an empty document has no
items; repeated rows give repeated sequences; references to unknown digests stay
with null properties; a document's other columns are dropped, its key is kept.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

ROW = 192
WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
ITEM = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """payload: whole rows, at least one."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples; checks every chunk's CRC."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad CRC in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 2):
                raise ValueError("only 8-bit RGB is stored")
            size = width, height
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] * 3 + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return size[0], size[1], lines[:, 1:].tobytes()


def image_feature(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation, entropy of the samples in bits, and a 64-bit difference hash of the luma."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / len(a)
    dev = max(0.0, float(counts @ (level * level)) / len(a) - mean * mean) ** 0.5
    p = counts[counts > 0] / len(a)
    entropy = float(-(p * np.log2(p)).sum())
    luma = a.reshape(height, width, 3).sum(axis=2, dtype=np.int64)
    ys = np.linspace(0, height, 9).astype(int)[:-1]
    rows = np.stack([luma[y] for y in ys])
    cells = np.add.reduceat(rows, np.linspace(0, width, 10).astype(int)[:-1], axis=1)
    bits = "".join("1" if x else "0" for x in (cells[:, 1:] > cells[:, :-1]).ravel())
    return f"{width}x{height};mean={mean:.4f};dev={dev:.4f};entropy={entropy:.4f};dhash={int(bits, 2):016x}"


class _Sequence(HTMLParser):
    """Ordered items of a document; a figure's caption belongs to its image."""

    SKIP, BLOCK = {"script", "style", "template", "noscript"}, {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "section", "article", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "body", "ul", "ol", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buf: list[str] = []
        self.skip = 0
        self.figure: int | None = None
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.buf).split())
        self.buf = []
        if not text:
            return
        if self.caption and self.figure is not None and self.figure < len(self.items):
            for item in self.items[self.figure :]:
                item[3] = text if item[3] is None else f"{item[3]} {text}"
        else:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)
            self.caption = self.caption or tag == "figcaption"
        elif tag in ("img", "video", "audio", "source"):
            given = dict(attrs)
            src = given.get("src") or ""
            if m := re.fullmatch(r"(?:urn:)?sha256:([0-9a-f]{64})", src.strip()):
                self.flush()
                self.items.append([tag, None, m[1], given.get("alt") or None])

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCK:
            self.flush()
            if tag == "figcaption":
                self.caption = False
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(p.items)]


def _sequence_of(html: pd.Series) -> pd.Series:
    return html.map(parse_sequence)


def _described(batches):
    """Reads stored bytes back: a row of properties per stored object, with its text-free payload facts."""
    for pdf in batches:
        rows = []
        for digest, media in zip(pdf["digest"], pdf["media"], strict=True):
            media = bytes(media)
            width, height, samples = decode_png(media)
            rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(width, height, samples)))
        yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe_store(store: DataFrame) -> DataFrame:
    """One row per digest of a store (digest, media)."""
    rows = store.select("digest", "media").mapInPandas(_described, DESCRIBED)
    return rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in rows.columns[1:]])


def interleave(pages: DataFrame, described: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row per item of each document: key, pos, kind, text, digest, caption, resolved and the store's properties."""
    items = pages.select(F.col(f"`{key}`").alias("_key"), F.explode(F.pandas_udf(_sequence_of, ITEM)(F.col(f"`{html}`"))).alias("_item")).select("_key", "_item.*")
    out = items.join(described, "digest", "left").withColumn("resolved", F.col("payload_bytes").isNotNull())
    return out.withColumnRenamed("_key", key)


def sequences(items: DataFrame, key: str) -> DataFrame:
    """Documents put together again: key and items in order of position."""
    fields = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"]))).alias("items"))


def _stored(batches):
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            data = (text if isinstance(text, str) else "").encode("utf-8", "replace")
            media = encode_png(pad(data))
            digest = hashlib.sha256(media).hexdigest()
            page = f'<figure><img src="urn:sha256:{digest}"><figcaption>{_html.escape(str(len(data)))} bytes</figcaption></figure>'
            rows.append((doc_id, page, len(data), digest, media))
        yield pd.DataFrame(rows, columns=["doc_id", "html", "n_bytes", "digest", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """Every text as a stored image, with the page that refers to it; a table in the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "media-store")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, html string, n_bytes long, digest string, media binary"
    docs.select("doc_id", "text").mapInPandas(_stored, schema).write.option("compression", "none").parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_media_report(docs: DataFrame) -> DataFrame:
    """Each document's text through store, page, parse and digest join; n_bytes comes from the caption."""
    stored = store_texts(docs)
    items = interleave(stored, describe_store(stored), "doc_id").where("kind = 'img'")
    n_bytes = F.regexp_extract("caption", r"(\d+) bytes", 1).cast("long").alias("n_bytes")
    return items.select("doc_id", n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
