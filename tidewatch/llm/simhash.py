"""Near duplicates by SimHash, compared in bit slices.

A text's fingerprint has a bit set where more than half of the XXH64 hashes of
its word shingles have it. Distinct fingerprints within RADIUS bits are linked;
components of links are the classes.

Candidates are exact: two fingerprints at most RADIUS bits apart agree in one of
RADIUS + 1 bands, so fingerprints meet by band and value. A bucket of at most
BUCKET fingerprints is compared by brute force. A larger one, of up to LARGE, is
dealt to tiles in which each pair meets; one beyond that is split again by
RADIUS + 1 bands of the bits that are still open, as long as SPLIT_BITS are, so
three times at most, and dealt to tiles after that. No pair is lost on any way.

Comparison: the 64 bits of a bucket are stored as planes, 64 fingerprints a word.
A fingerprint meets a word with one XOR a plane; the differing bits of its 64
distances are added by carry-save counters (three bits and a flag for more), two
planes at a time, and every few planes the words all of whose distances exceed
the radius are left. Many buckets are compared at once. A bucket gives star edges.

Defined cases: a null or empty text has fingerprint 0 and is linked like any
other; fewer words than SHINGLE are one shingle; equal fingerprints are one node,
so repeated rows and groups of copies cost a row each; component_id is the
smallest doc_id of the class, null if it has none; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, discard, shuffle_partitions, written

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
BUCKET, LARGE, CHUNK, SPLIT_BITS = 4096, 65536, 2048, 40
SALTS = 16
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def hashes(text: bytes) -> list[int]:
    """XXH64 of the shingles, repeats included."""
    found = text.lower().split()
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    if len(found) <= SHINGLE:
        return [xxh64_intdigest(line, SEED)] if found else []
    return [xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]  # noqa: B905


def fingerprint(text: bytes) -> np.uint64:
    h, n = np.array(hashes(text), np.uint64), np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        n += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * n > len(h), bitorder="little").view(np.uint64)[0]


def _fingerprinted(batches):
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            made = np.array([fingerprint(t or b"") for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprinted, f"doc_id {kind}, fp long")


def bands(mask: int) -> list[int]:
    """RADIUS + 1 masks that share out the bits of a mask."""
    bits = [k for k in range(BITS) if mask >> k & 1]
    cuts = [len(bits) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [sum(1 << k for k in bits[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints, a multiple of 64 of them, as [bit, word]: bit k of a plane's word is that of its k-th fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def close_lanes(sliced: np.ndarray, valid: np.ndarray, words: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints of each word lie within RADIUS of the fingerprint beside it: index into words, and lanes as bits."""
    at = np.arange(len(words))
    ones, twos, fours, dead = (np.zeros(len(words), np.uint64) for _ in range(4))
    for p in range(0, BITS, 2):
        a, b = (sliced[q, words] ^ (U(0) - (fps >> U(q) & U(1))) for q in (p, p + 1))
        half = ones ^ a
        carry = ones & a | half & b
        ones = half ^ b
        over = twos & carry
        twos ^= carry
        dead |= fours & over
        fours |= over
        dead |= _beyond(ones, twos, fours)
        if p % 8 == 6:
            left = np.flatnonzero(~dead & valid[words])
            if len(left) < len(words):
                at, words, fps, ones, twos, fours, dead = (x[left] for x in (at, words, fps, ones, twos, fours, dead))
    return at, ~dead & valid[words]


def _beyond(ones, twos, fours):
    """Lanes whose count is above RADIUS (below 8), compared from the highest bit."""
    more, same = np.zeros_like(ones), np.full_like(ones, ALL)
    for bit, c in ((4, fours), (2, twos), (1, ones)):
        if RADIUS & bit:
            same &= c
        else:
            more |= same & c
            same &= ~c
    return more


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives linked nodes and all that share their labels the smallest of the labels."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def star_edges(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the components of links within runs of equal keys."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)])
    width = -(-size // 64)
    first = np.cumsum(width) - width
    bucket = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(keys)) - begin[bucket] + 64 * first[bucket]
    laid, valid, who = np.zeros(64 * width.sum(), np.uint64), np.zeros(64 * width.sum(), np.uint8), np.zeros(64 * width.sum(), np.int64)
    laid[place], valid[place], who[place] = fps, 1, np.arange(len(keys))
    sliced, lanes = planes(laid), np.packbits(valid, bitorder="little").view(np.uint64)
    label = np.arange(len(keys))
    left = first[bucket] + width[bucket] - place // 64  # words from a row's own on
    ahead = np.cumsum(left)
    at = 0
    while at < len(keys):  # about a million meetings of a row and a word at once
        end = max(at + 1, int(np.searchsorted(ahead, ahead[at] - left[at] + (1 << 20), side="right")))
        row = np.repeat(np.arange(at, end), left[at:end])
        word = place[row] // 64 + np.arange(len(row)) - (ahead[row] - left[row] - (ahead[at] - left[at]))
        met, alive = close_lanes(sliced, lanes, word, fps[row])
        for k in range(0, len(met), 1 << 15):
            part = slice(k, k + (1 << 15))
            pair, lane = np.nonzero(np.unpackbits(alive[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = row[met[part]][pair], who[64 * word[met[part]][pair] + lane]
            _joined(label, i[i < j], j[i < j])
        at = end
    linked = np.flatnonzero(label != np.arange(len(keys)))
    return fps[linked], fps[label[linked]]


def _compared(batches):
    held: list[pd.DataFrame] = []
    rows = 0

    def flush(last: bool):
        nonlocal held, rows
        whole = pd.concat(held)
        keys = whole["key"].to_numpy()
        end = len(keys) if last else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if end:
            a, b = star_edges(keys[:end], whole["fp"].to_numpy()[:end].view(np.uint64))
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        held, rows = [whole.iloc[end:]], len(keys) - end

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= 1 << 15:
            yield from flush(last=False)
    if rows:
        yield from flush(last=True)


def compared(nodes: DataFrame) -> DataFrame:
    """Star edges (a, b) within the buckets of (key, fp)."""
    dealt = nodes.select("key", "fp").repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(_compared, "a long, b long")


def _sized(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def _split(nodes: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
    """Members of nodes (key, path, fp) in the buckets of the next level; path indexes the masks of open bits."""
    below = [bands(m) for m in masks]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    of = F.array(*[F.array(*[F.lit(signed(m)).cast("long") for m in own]) for own in below])
    took = nodes.select("key", "path", "fp", F.posexplode(F.element_at(of, F.col("path") + 1)).alias("band", "mask"))
    child = took.select(F.xxhash64("key", "band", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), (F.col("path") * (RADIUS + 1) + F.col("band")).cast("int").alias("path"), "fp")
    return child, [m & ~b for m, own in zip(masks, below, strict=True) for b in own]


def _tiles(nodes: DataFrame) -> DataFrame:
    """Members of nodes (key, fp, size) in tiles of two chunks of their bucket."""
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = nodes.select("key", "fp", chunks.alias("chunks"), F.pmod(F.xxhash64(F.lit(11), "fp"), chunks).alias("c")).select("key", "fp", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("o"))
    return dealt.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("key"), "fp")


def links(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Star edges (a, b) of distinct fingerprints (fp) within RADIUS, and the tables they are read from."""
    cur, masks = _split(nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("path"), "fp"), [(1 << BITS) - 1])
    edges, read = [], []
    while True:
        met = written(_sized(cur), "simhash-buckets")
        read.append(met)
        edges += [compared(met.where(F.col("size") <= BUCKET))]
        # all paths of a level have about as many open bits
        last = min(m.bit_count() for m in masks) < SPLIT_BITS
        over = met.where((F.col("size") > BUCKET) & ((F.col("size") <= LARGE) | F.lit(last)))
        if not over.isEmpty():
            edges += [compared(_tiles(over))]
        huge = met.where(F.col("size") > LARGE)
        if last or huge.isEmpty():
            break
        cur, masks = _split(huge, masks)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionAll(more)
    return out, read


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id."""
    made = written(fingerprints(docs), "simhash-fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges, read = links(nodes)
    roots = components(edges, "simhash-components")
    of = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = of.select("fp", "root").join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    # copies of one text may be a third of all rows: they are dealt by fingerprint and salt
    named = named.select("fp", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = made.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    out = salted.join(named, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    out = written(out, "simhash-classes")
    discard(made, nodes, roots, *read)
    return out
