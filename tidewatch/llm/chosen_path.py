"""Near-duplicate documents: Jaccard join of word-shingle sets by chosen paths.

A document's set holds the hashes of its runs of SHINGLE words (all words, if it
has fewer); words are what ASCII white space separates. Documents with equal
sets are one class from the start and are represented once.

Candidates: in each of RUNS runs a set walks down a tree of sampled tokens. At the
root it takes each token with probability 1 / (threshold |set|), at a node below
d tokens each of its other tokens with BRANCH times 1 / (threshold |set| - d),
decided by a hash of token and node that all sets share, and goes to the child
named by path and token. Two sets at the threshold have one common child of a
root on average at least and BRANCH of any other node (just so many, where one
set holds the other), independently at every node they share. Nodes of at most
BUCKET sets are compared by brute force, larger ones are split again, as often as
it takes.

Recall by calculation: a common node leads to common nodes k levels below with
probability q(k) = 1 - exp(-BRANCH q(k - 1)), q(0) = 1, which falls to 0.25 and
no further; a run brings the pair to a common node k + 1 levels below the root
with probability 1 - exp(-q(k)). One of RUNS runs does so with 0.999999 at the
first level, 0.9997 at the third and 0.976 at any. A larger BRANCH would let the
nodes of sets that share most tokens, but not enough, grow in number with depth;
at this one their number falls unless sets are so near that pivots take them.
A node of BUCKET sets costs its task about a second.

Copies would stay together however often their node is split. So a node of more
than BUCKET sets first meets PIVOTS of its own sets (those of the least hashes):
sets within NEAR of a pivot join it and leave the node, and as Hamming distance
is a metric, whatever is near one of those lies within 2 NEAR of the pivot and is
joined to it as well. What stays is split. Each set gives a node one edge, so
that the edges of a group of copies grow with the group, not with its square.

Nodes compare sizes and one-bit min-wise sketches (SKETCH_BITS, and FINE_BITS for
over-full nodes); the limits lie four standard deviations beyond the expectation
at the threshold. Nodes emit star edges only. Connected candidates then meet once
more with their whole sets and all their pairs are decided exactly. A group of
more than one tile is first compared with PIVOTS of its sets: sets at 0.9 or more
to one pivot are a core, and by the triangle inequality of Jaccard distance all
pairs in a core are links, counted without a look at them. Only the pairs outside
a common core are decided tile by tile, each pair in one tile. A tile emits a
count of links per set and star edges, never pairs; the final classes are the
components of these.

Defined cases: null texts count as empty, documents without words are copies of
each other without links; rows that share a doc_id are judged each by its text,
a row is told from others by doc_id and a hash of its text; the class id is the
smallest doc_id of the class (null if it has none); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, perhaps_in, shuffle_partitions, slices, written

SHINGLE, THRESHOLD = 5, 0.8
RUNS, BRANCH, BUCKET, PIVOTS = 15, 1.15, 4096, 4
TILE_SETS, TILE_TOKENS, CORE = 1024, 2_000_000, 0.9
SKETCH_BITS, FINE_BITS = 256, 2048
SMALL = 32  # sets of a bucket that is compared together with others
REMEMBERED = 1 << 16  # sets that a task remembers to leave out the nodes of their copies
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
ODD = _RNG.integers(0, 1 << 63, RUNS, dtype=np.uint64) * U(2) + U(1)
FINE_ODD = _RNG.integers(0, 1 << 63, FINE_BITS, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U(pow(base, size, 1 << 64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate([[U(0)], np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)])])
    words = mix((total[end] - total[begin]) * down[begin])
    k = min(SHINGLE, len(words))
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h = mix(h) + words[j : len(words) - k + 1 + j]
    return np.unique(mix(h + U(k)))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """One bit of each min-wise hash."""
    odd = FINE_ODD[:bits]
    low, step = np.full(bits, np.iinfo(np.uint64).max, np.uint64), (1 << 17) // bits
    for at in range(0, len(s), step):
        np.minimum(low, (s[at : at + step, None] * odd).min(axis=0), out=low)
    return np.packbits((mix(low) & U(1)).astype(np.uint8)).tobytes()


def near(bits: int) -> int:
    """The greatest number of differing bits at which sketches count as near: four deviations over the threshold's mean."""
    p = (1 - THRESHOLD) / 2
    return int(bits * p + 4 * (bits * p * (1 - p)) ** 0.5)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing bits of sketches, held as 64-bit words on the last axis."""
    total = 0
    for k in range(a.shape[-1]):
        total = total + np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int32)
    return total


def _bar(n: int, depth: int) -> np.uint64:
    """The greatest hash with which a set of n tokens takes one at a node below depth tokens."""
    left = (THRESHOLD * n - depth) / (BRANCH if depth else 1)
    return U(np.iinfo(np.uint64).max) if left <= 1 else U(int(2**64 / left))


def descents(s: np.ndarray, keys: np.ndarray, paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children a set reaches from nodes it is in, given by key and tokens taken: index of the node, token and key."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    path = np.array(paths, np.int64).view(np.uint64)
    bar, at_once, i, j = _bar(len(s), path.shape[1]), max(1, (1 << 18) // max(1, len(s))), [], []
    for at in range(0, len(keys), at_once):
        a, b = np.nonzero(mix(s ^ keys[at : at + at_once, None]) <= bar)
        i.append(a + at)
        j.append(b)
    i, token = np.concatenate(i), s[np.concatenate(j)]
    new = (path[i] != token[:, None]).all(axis=1)
    i, token = i[new], token[new]
    return i, token, mix(token + mix(keys[i]))


def sampled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs and tokens the set takes at their roots."""
    if not len(s):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    bar = _bar(len(s), 0)
    slots, tokens = [], []
    for at in range(0, len(s), 8192):
        i, j = np.nonzero(s[at : at + 8192, None] * ODD <= bar)
        slots.append(j)
        tokens.append(s[at + i])
    return np.concatenate(slots).astype(np.int32), np.concatenate(tokens).view(np.int64)


def _featured(batches):
    seen: dict[bytes, bytes] = {}
    for b in batches:
        ids, texts, hashes = b.column("doc_id"), b.column("text"), b.column("text_hash")
        for at in range(0, len(b), 512):
            sids, sizes, marks, slots, tokens = [], [], [], [], []
            for text in texts.slice(at, 512).to_pylist():
                s = shingles(text)
                sid = digest(s)
                # a copy is in the nodes of its set already
                i, t = sampled(s[:0] if sid in seen else s)
                if sid not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[sid] = sketch(s)
                sids.append(sid)
                sizes.append(len(s))
                marks.append(seen[sid])
                slots.append(i)
                tokens.append(t)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in slots])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, 512), hashes.slice(at, 512), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(slots))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens)))],
                names=["doc_id", "text_hash", "sid", "n", "sketch", "slots", "tokens"],
            )


def features(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_featured, f"doc_id {kind}, text_hash long, sid binary, n int, sketch binary, slots array<int>, tokens array<long>")


class _Roots:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.up[j] = i


def _stars(ids: list, rows: np.ndarray, cols: np.ndarray) -> list[tuple]:
    """Star edges (member, root) of the pairs' components."""
    roots = _Roots(len(ids))
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        if roots.find(i) != roots.find(j):
            roots.join(i, j)
    return [(ids[i], ids[r]) for i in range(len(ids)) if (r := roots.find(i)) != i]


def _grouped(batches, key: str):
    """Frames of equal key from batches sorted by key."""
    held = []
    for pdf in batches:
        keys = pdf[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part in np.split(np.arange(len(keys)), cuts):
            piece = pdf.iloc[part[0] : part[-1] + 1] if len(part) else pdf
            if held and len(piece) and held[-1][key].iloc[0] != piece[key].iloc[0]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            if len(piece):
                held.append(piece)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def _runs(batches, key: str):
    """Frames of whole groups of equal key, many at once, from batches sorted by key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        keys = pdf[key].to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or held and held[-1][key].iloc[-1] != keys[0]:
            yield pd.concat([*held, pdf.iloc[:cut]])
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


def _compared(batches):
    """Star edges of the pairs of each bucket that sizes and sketches leave."""
    reach = near(SKETCH_BITS)
    for pdf in _runs(batches, "key"):
        keys, n = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        marks = np.frombuffer(b"".join(map(bytes, pdf["sketch"])), np.uint64).reshape(len(n), -1)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(begin, len(keys)))
        pairs = []
        # small buckets together, rows that lie d apart at a time
        few = np.flatnonzero(np.repeat(size <= SMALL, size))
        for d in range(1, SMALL):
            i, j = few[:-d], few[d:]
            met = (keys[i] == keys[j]) & (np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[met], j[met]
            close = differing(marks[i], marks[j]) <= reach
            pairs.append((i[close], j[close]))
        for first, rows in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            m, own = n[first : first + rows], marks[first : first + rows]
            for at in range(0, rows, 256):
                part = slice(at, at + 256)
                close = (differing(own[part, None], own[None]) <= reach) & (np.minimum(m[part, None], m) >= THRESHOLD * np.maximum(m[part, None], m) - 1e-9)
                i, j = np.nonzero(close)
                apart = i + at < j
                pairs.append((first + at + i[apart], first + j[apart]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        rows, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        yield pd.DataFrame(_stars([bytes(x) for x in pdf["sid"].to_numpy()[rows]], where[: len(i)], where[len(i) :]), columns=["a", "b"])


def compared(nodes: DataFrame) -> DataFrame:
    """Star edges (a, b) within nodes of at most BUCKET sets."""
    dealt = nodes.select("key", "sid", "n", "sketch").repartition(shuffle_partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "sid")
    return dealt.mapInPandas(_compared, "a binary, b binary")


def _sets_of(fine: bool):
    def sets(batches):
        for b in batches:
            for part in slices(b, "text", 256):
                found = [shingles(text) for text in part.column("text").to_pylist()]
                columns = {"sid": [digest(s) for s in found], "tokens": [s.tobytes() for s in found]} | ({"fine": [sketch(s, FINE_BITS) for s in found]} if fine else {})
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns.values()], names=list(columns))

    return sets


def whole_sets(docs: DataFrame, sets: DataFrame, fine: bool = False) -> DataFrame:
    """(sid, tokens) of sets (written, a document of each in _rep), with their fine sketches if asked for. Sets are made where the texts are read, so that texts aren't shuffled."""
    h = lambda doc_id, text_hash: F.xxhash64(doc_id, text_hash).alias("h")
    rows = perhaps_in(docs.select("text", h("doc_id", F.xxhash64("text"))), sets.select(h("_rep.doc_id", "_rep.text_hash")))
    made = rows.select("text").mapInArrow(_sets_of(fine), "sid binary, tokens binary" + ", fine binary" * fine)
    return made.join(sets.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _judged(batches):
    reach = near(FINE_BITS)
    for b in batches:
        for at in range(0, len(b), 1024):
            part = b.slice(at, 1024)
            own, those = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(len(part), -1, FINE_BITS // 64) for c in ("fine", "fines"))
            far = differing(own, those)
            apart = differing(those[:, :, None], those[:, None]) > 2 * reach
            roots = []
            for k, (sid, pivots) in enumerate(zip(part.column("sid").to_pylist(), part.column("pivots").to_pylist(), strict=True)):
                met = np.flatnonzero(far[k] <= 2 * reach).tolist()
                # pivots within reach of an earlier one are joined to it by their own rows
                roots.append([pivots[i] for x, i in enumerate(met) if pivots[i] != sid and all(apart[k, j, i] for j in met[:x])])
            kept = [part.column(c) for c in NODE]
            yield pa.RecordBatch.from_arrays([*kept, pa.array((far <= reach).any(axis=1)), pa.array(roots, pa.list_(pa.binary()))], names=[*NODE, "joined", "roots"])


NODE = ["key", "sid", "n", "sketch", "path"]
NODE_TYPES = "key long, sid binary, n int, sketch binary, path array<long>"


def against_pivots(full: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of over-full nodes with the pivots they are joined to (roots) and whether they leave the node (joined)."""
    rows = full.select(*NODE).join(whole.select("sid", "fine"), "sid")
    least = [F.min(F.struct(F.xxhash64(F.lit(k), "sid").alias("h") if k else F.lit(0).alias("h"), "sid", "fine")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = rows.groupBy("key").agg(*least).select("key", F.array(*[f"p{k}.sid" for k in range(PIVOTS)]).alias("pivots"), F.concat(*[f"p{k}.fine" for k in range(PIVOTS)]).alias("fines"))
    return rows.join(pivots, "key").mapInArrow(_judged, f"{NODE_TYPES}, joined boolean, roots array<binary>")


def _split(batches):
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            rows, keys, paths = [], [], []
            for k, (tokens, nodes) in enumerate(zip(part.column("tokens").to_pylist(), part.column("nodes").to_pylist(), strict=True)):
                i, token, key = descents(np.frombuffer(tokens, np.uint64), np.array([x["key"] for x in nodes], np.int64).view(np.uint64), [x["path"] for x in nodes])
                rows += [k] * len(i)
                keys.append(key)
                paths += [[*nodes[x]["path"], t] for x, t in zip(i.tolist(), token.view(np.int64).tolist(), strict=True)]
            if rows:
                kept = [part.column(c).take(pa.array(rows)) for c in ("sid", "n", "sketch")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *kept, pa.array(paths, pa.list_(pa.int64()))], names=NODE)


def _sized(nodes: DataFrame) -> DataFrame:
    """The rows of nodes that more than one set is in, once each, with the size of the node; in one shuffle."""
    dealt = nodes.repartition(shuffle_partitions(nodes.sparkSession), "key").dropDuplicates(["key", "sid"])
    return dealt.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")


def candidate_edges(docs: DataFrame, feats: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Star edges between set ids that met in a node of some run and look alike, and the tables they are read from."""
    sets = feats.select("sid", "n", "sketch", F.explode(F.arrays_zip("slots", "tokens")).alias("t"))
    met = written(_sized(sets.select(F.xxhash64("t.slots", "t.tokens").alias("key"), "sid", "n", "sketch", F.array("t.tokens").alias("path"))), "path-level1")
    edges, read, whole = [], [met], None
    nodes = lambda rows: rows.where(F.col("size") <= BUCKET).select("key", "sid", "n", "sketch")
    small = nodes(met)
    while True:
        full = met.where(F.col("size") > BUCKET)
        if full.isEmpty():
            break
        if whole is None:
            one = written(feats.join(full.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("_rep")), "path-full")
            whole = written(whole_sets(docs, one, fine=True), "path-sets")
            read += [one, whole]
        judged = written(against_pivots(full, whole), "path-judged")
        edges.append(judged.select(F.col("sid").alias("a"), F.explode("roots").alias("b")))
        rest = _sized(judged.where("not joined").select(*NODE))
        split = rest.where(F.col("size") > BUCKET).groupBy("sid", "n", "sketch").agg(F.collect_list(F.struct("key", "path")).alias("nodes"))
        met = written(_sized(split.join(whole.select("sid", "tokens"), "sid").mapInArrow(_split, NODE_TYPES)), "path-level")
        small = small.unionAll(nodes(rest)).unionAll(nodes(met))
        read += [judged, met]
    out = compared(small)
    for more in edges:
        out = out.unionAll(more)
    return out, read


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by the cheaper of a matrix product and merging pairs."""
    b = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((b, b), np.float64 if sizes.max() >= 1 << 24 else np.float32)
    if b > 4:
        every, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        width = int(shared[-1]) + 1 if len(every) else 0
        keep = count[where] > 1
        rows, cols = np.repeat(np.arange(b), sizes)[keep], shared[where[keep]]
    if b > 4 and b * b * width * 0.05 < b * b / 2 * (20_000 + 20 * sizes.mean()):
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        step = max(64, (1 << 22) // b)
        for at in range(0, width, step):
            lo, hi = np.searchsorted(cols, (at, at + step))
            x = np.zeros((b, min(step, width - at)), out.dtype)
            x[rows[lo:hi], cols[lo:hi] - at] = 1
            out += x @ x.T
    else:
        for i in range(b):
            for j in range(i + 1, b):
                if min(sizes[i], sizes[j]) >= THRESHOLD * max(sizes[i], sizes[j]) - 1e-9:
                    out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return out


def _decided(batches):
    """Of each tile: a row (sid, links, null) per set with links, and star edges (sid, 0, root)."""
    for group in _grouped(batches, "key"):
        if len(group) < 2:
            continue
        ids, chunk = [bytes(x) for x in group["sid"]], group["chunk"].to_numpy()
        sets = [np.frombuffer(bytes(x), np.uint64) for x in group["tokens"]]
        n = np.array([len(s) for s in sets], np.float64)
        close = intersections(sets).astype(np.float64) * (1 + THRESHOLD) >= THRESHOLD * (n[:, None] + n) - 1e-6
        np.fill_diagonal(close, False)
        if not group["own"].iloc[0]:
            close &= chunk[:, None] != chunk  # pairs within a chunk belong to the chunk's own tile
        links = close.sum(axis=1)
        i, j = np.nonzero(np.triu(close))
        rows = [(ids[k], int(links[k]), None) for k in np.flatnonzero(links).tolist()] + [(a, 0, b) for a, b in _stars(ids, i, j)]
        if rows:
            yield pd.DataFrame(rows, columns=["sid", "links", "root"])


def _cored(batches):
    """Of each chunk with the pivots of its group: sid and the number of the first pivot it is at CORE or more to."""
    for group in _grouped(batches, "key"):
        rank = group["rank"].to_numpy()
        sets = [np.frombuffer(bytes(x), np.uint64) for x in group["tokens"]]
        pivots = [sets[k] for k in sorted(np.flatnonzero(rank >= 0).tolist(), key=lambda k: rank[k])]  # noqa: B023
        out = []
        for k in np.flatnonzero(rank < 0).tolist():
            for r, p in enumerate(pivots):
                small, large = sorted((len(sets[k]), len(p)))
                if small >= CORE * large - 1e-9 and len(np.intersect1d(sets[k], p, assume_unique=True)) * (1 + CORE) >= CORE * (small + large) - 1e-9:
                    out.append((bytes(group["sid"].iloc[k]), r))
                    break
        yield pd.DataFrame(out, columns=["sid", "core"]).astype({"core": "int32"})


def _chunks():
    return F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_TOKENS)).cast("int").alias("chunks")


def cores(large: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sid, core) of those members (sid, group, n, chunks) of large groups that are at CORE or more to a pivot of their group."""
    ranks = [F.struct(F.min(F.struct(F.xxhash64(F.lit(k), "sid").alias("h"), "sid"))["sid"].alias("sid"), F.lit(k).alias("rank")) for k in range(PIVOTS)]
    chosen = large.groupBy("group", "chunks").agg(F.array(*ranks).alias("p")).select("group", "chunks", F.explode("p").alias("p"))
    pivots = chosen.select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "p.sid", "p.rank")
    rows = large.select("group", F.pmod(F.xxhash64(F.lit(3), "sid"), "chunks").cast("int").alias("chunk"), "sid", F.lit(-1).alias("rank")).unionAll(pivots)
    rows = rows.select(F.xxhash64("group", "chunk").alias("key"), "sid", "rank").join(tokens, "sid")
    dealt = rows.repartition(shuffle_partitions(large.sparkSession), "key").sortWithinPartitions("key", "sid")
    return dealt.mapInPandas(_cored, "sid binary, core int")


def _tiles(members: DataFrame) -> DataFrame:
    """Members (sid, group, core, n) for every tile (key, chunk, own) they are in: all pairs of chunks but those of one core."""
    sized = members.groupBy("group", "core").agg(_chunks())
    labels = sized.select("group", "core", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"))
    left, right = (labels.select("group", *[F.col(c).alias(f"{c}{k}") for c in ("core", "c")]) for k in (1, 2))
    meet = (F.col("core1") < F.col("core2")) | (F.col("core1") == -1) & (F.col("core2") == -1) & (F.col("c1") <= F.col("c2"))
    pairs = left.join(right, "group").where(meet).withColumn("own", (F.col("core1") == F.col("core2")) & (F.col("c1") == F.col("c2")))
    side = lambda k: F.struct(F.col(f"core{k}").alias("core"), F.col(f"c{k}").alias("c"))
    ends = F.when(F.col("own"), F.array(side(1))).otherwise(F.array(side(1), side(2)))
    met = pairs.select("group", "own", F.xxhash64("group", "core1", "c1", "core2", "c2").alias("key"), F.explode(ends).alias("e")).select("group", "own", "key", "e.core", "e.c")
    dealt = members.join(sized, ["group", "core"]).withColumn("c", F.pmod(F.xxhash64(F.lit(5), "sid"), "chunks").cast("int"))
    return dealt.join(met, ["group", "core", "c"]).select("sid", "key", F.xxhash64("core", "c").alias("chunk"), "own")


def similar_sets(docs: DataFrame, feats: DataFrame) -> DataFrame:
    """(sid, links, root) as tiles and cores decide them, written; all pairs of sets at or above the threshold are counted once."""
    spark = docs.sparkSession
    edges, read = candidate_edges(docs, feats)
    groups = components(edges, "candidate-components")
    discard(*read)
    # one document for each set; copies of its text hold the same set
    one = feats.select("sid", "doc_id", "text_hash", "n").join(groups.withColumnsRenamed({"id": "sid", "root": "group"}), "sid").groupBy("sid", "group", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("_rep"))
    one = written(one, "candidate-sets")
    discard(groups)
    sizes = one.groupBy("group").agg(_chunks())
    members = one.select("sid", "group", "n").join(sizes, "group")
    small = members.where("chunks = 1").select("sid", F.xxhash64("group").alias("key"), F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("own"))
    tokens = written(whole_sets(docs, one), "candidate-tokens")
    large, made, known = members.where("chunks > 1"), [], None
    if not large.isEmpty():
        core = written(cores(large, tokens), "large-cores")
        made = [core]
        placed = large.select("sid", "group", "n").join(core, "sid", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
        small = small.unionAll(_tiles(placed))
        same = placed.where("core >= 0")
        known = same.join(same.groupBy("group", "core").agg(F.count("*").alias("sets"), F.min("sid").alias("root")), ["group", "core"]).where("sets > 1").select("sid", (F.col("sets") - 1).alias("links"), F.when(F.col("sid") != F.col("root"), F.col("root")).alias("root"))
    dealt = small.join(tokens, "sid").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "sid")
    found = dealt.mapInPandas(_decided, "sid binary, links long, root binary")
    decided = written(found.unionAll(known) if known is not None else found, "set-links")
    discard(one, tokens, *made)
    return decided


def _with_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of the documents, and of each set sid, root (of its class), class_id, n_links, n_copies."""
    feats = written(features(docs), "set-features")
    decided = similar_sets(docs, feats)
    roots = components(decided.where("root is not null").select(F.col("sid").alias("a"), F.col("root").alias("b")), "set-components").withColumnRenamed("id", "sid")
    links = decided.groupBy("sid").agg(F.sum("links").alias("n_links"))
    sets = feats.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")).join(roots, "sid", "left").join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    return feats, sets.join(least, "root").select("sid", "root", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")


def classes(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id, n_links (similar documents with other sets, copies counted once), n_copies."""
    feats, sets = _with_sets(docs)
    return feats.select("doc_id", "sid").join(sets, "sid").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs reduced to one row of each class: of those with its smallest doc_id (none, if it has none) the first by a hash of the text."""
    feats, sets = _with_sets(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = feats.groupBy("sid").agg(F.min(row).alias("row")).join(sets.select("sid", "root"), "sid").groupBy("root").agg(F.min("row").alias("row"))
    stay = best.select(F.col("row.doc_id").alias("_stays"), F.col("row.text_hash").alias("_hash"))
    # equal rows count as one: how often those that stay are there
    met = (F.col("doc_id").eqNullSafe(F.col("_stays"))) & (F.col("text_hash") == F.col("_hash"))
    stay = written(feats.select("doc_id", "text_hash").join(stay, met).groupBy("_stays", "_hash").agg((F.count("*") > 1).alias("_repeats")), "set-stays")
    # the rest of a row travels as one column, so its names can't meet those used here
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    of = lambda keys: packed.join(keys.hint("shuffle_hash"), met, "left_semi")
    out = of(stay.where("not _repeats")).select("_row")
    if not stay.where("_repeats").isEmpty():
        out = out.unionAll(of(stay.where("_repeats")).dropDuplicates(["doc_id", "text_hash"]).select("_row"))
    return out.select([F.col("_row")[c].alias(c) for c in docs.columns])
