"""Nearest neighbours by block matrix join of int8 codes with exact rescoring.

Vectors are packed into blocks: ids, original components, int8 codes with one
scale a vector, and the norm of each vector's quantisation residue. The blocks
of both sides are written once to the shared folder. Every pair of a share of
the candidate blocks and a share of the query blocks is one task (a Cartesian
product of the two tables of blocks), which reads its blocks from there, so no
block is shuffled, copied on disk or gathered, and what is written grows with
the table. A task passes its candidate blocks by each query block and keeps the
k best so far of every query. For a pair of blocks, a tile:

1. a product of the int8 codes (held as floats and summed in parts of EXACT
   components, which is exact for such integers) gives approximate cosines;
2. with u = s c + r for unit vectors, |u v - s c t d| <= |r_v| + |r_u| |t d|,
   which bounds the error of each cosine;
3. a pair survives if its upper bound reaches the query's bar, its k-th best
   score so far or, before there are k, the k-th largest lower bound of the
   tile, so no true neighbour is lost;
4. survivors are recomputed in double precision on the original components, a
   bounded number at a time, and merged into the k best of their queries.

A task gives k rows a query, so each query has at most SHARES times k rows,
which are merged by rank over (score descending, vec_id). Recall is 1 by
construction. Work is queries times candidates; it is spread over tasks.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without id, take no part; vectors of unequal length do not
meet; rows that share an id are queries and candidates of their own, and only a
query's own row is no candidate of it, so equal rows find each other; components of
any finite size count (cosines are taken on vectors scaled by powers of two);
fewer candidates than k are all returned; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
BLOCK_BYTES = 8 << 20  # of a block at most, so that blocks of long vectors hold fewer
QUERY_BLOCKS, SHARES = 8, 32  # query blocks of a written file, shares of the candidate blocks
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 128, 1 << 13
EXACT = 1024  # so many products of codes sum exactly in single precision; more are summed in parts
SLACK = 2.0**-20  # for rounding of scales, residues and single precision, relative to 1, for each part
BLOCK = "block long, dim int, n int, ids binary, hashes binary, copies binary, vectors binary, codes binary, scales binary, residues binary"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id long, h long, copies long, v array<double>) of finite, nonzero vectors: of equal rows one with their number, h a hash of v."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0.0))
    rows = rows.select("vec_id", F.xxhash64("v").alias("h"), F.lit(1).cast("long").alias("copies"), "v")
    # only rows whose id repeats are grouped; the rest needs no shuffle
    repeated = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "vec_id", "left_anti").unionAll(rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id", "h", "v").agg(F.count("*").alias("copies")).select("vec_id", "h", "copies", "v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and residue norms of the unit vectors along x."""
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    residue = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((residue * residue).sum(axis=1))


def _packer(size: int):
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}

        def block(dim, most):
            nonlocal made
            columns = [np.concatenate(x) for x in zip(*held.pop(dim), strict=True)]
            if len(columns[0]) > most:
                held[dim] = [tuple(x[most:] for x in columns)]
            ids, hashes, copies, x = (c[:most] for c in columns)
            codes, scale, residue = quantise(x)
            with np.errstate(over="ignore"):
                narrow = x.astype(np.float32)
            x = narrow if (narrow == x).all() else x
            made += 1
            row = [(task << 24) + made, dim, len(ids), *(c.tobytes() for c in (ids, hashes, copies, x, codes, scale, residue))]
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            names, types = zip(*(c.split() for c in BLOCK.split(", ")), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([value], kinds[kind]) for value, kind in zip(row, types, strict=True)], names=list(names))

        for batch in batches:
            v = batch.column("v")
            starts, values = v.offsets.to_numpy(), v.values.to_numpy()
            for dim in np.unique(lengths := np.diff(starts)).tolist():
                at, most = np.flatnonzero(lengths == dim), min(size, max(1, BLOCK_BYTES // (9 * dim + 40)))
                held.setdefault(dim, []).append((*(batch.column(c).to_numpy()[at] for c in ("vec_id", "h", "copies")), values[starts[at][:, None] + np.arange(dim)]))
                while sum(len(x[0]) for x in held.get(dim, ())) >= most:
                    yield block(dim, most)
        for dim in sorted(held):
            yield block(dim, size)

    return pack


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.mapInArrow(_packer(size), BLOCK)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last.

    Vectors are first scaled by powers of two, which changes no bit of a cosine but keeps squares finite.
    """
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (q, v))
    dot, a, b = (np.zeros(len(q)) for _ in range(3))
    for d in range(q.shape[1]):
        x, y = q[:, d], v[:, d]
        dot += x * y
        a += x * x
        b += y * y
    return dot / (np.sqrt(a) * np.sqrt(b))


class Best:
    """The k best candidates so far of each query of a block, best first; -inf where there are fewer."""

    def __init__(self, n: int, k: int) -> None:
        self.ids, self.scores = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, times: np.ndarray) -> None:
        k = self.ids.shape[1]
        kept = scores >= self.scores[rows, -1]
        rows, ids, scores = (np.repeat(x[kept], np.minimum(times[kept], k)) for x in (rows, ids, scores))
        touched = np.unique(rows)
        rows, ids, scores = np.concatenate([rows, np.repeat(touched, k)]), np.concatenate([ids, self.ids[touched].ravel()]), np.concatenate([scores, self.scores[touched].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < k
        self.ids[rows[first], place[first]], self.scores[rows[first], place[first]] = ids[first], scores[first]


def tile(q: dict, c: dict, best: Best) -> None:
    """Merges the candidates of a block into the best of a block of queries."""
    n, m = len(q["ids"]), len(c["ids"])
    # a query's own row is left out, further copies of it are candidates
    near = np.flatnonzero(np.isin(c["ids"], q["ids"]))
    own = np.zeros((2, 0), np.int64)
    if len(near):
        i, j = np.nonzero((q["ids"][:, None] == c["ids"][near]) & (q["hashes"][:, None] == c["hashes"][near]))
        own = np.array([i, near[j]])
    for at in range(0, n, QUERIES_AT_ONCE):
        to = min(n, at + QUERIES_AT_ONCE)
        _strip({name: x[at:to] for name, x in q.items()}, c, best, at, own[0, here := (own[0] >= at) & (own[0] < to)] * m + own[1, here])


def _strip(q: dict, c: dict, best: Best, first: int, own: np.ndarray) -> None:
    """own: places, as row times candidates plus column, of the queries' own rows in the table of the whole block."""
    n, m, k, dim = len(q["ids"]), len(c["ids"]), best.ids.shape[1], q["codes"].shape[1]
    own = own - first * m
    codes = q["codes"].astype(np.float32)
    approx = codes[:, :EXACT] @ c["columns"][:EXACT]
    for at in range(EXACT, dim, EXACT):
        approx += codes[:, at : at + EXACT] @ c["columns"][at : at + EXACT]
    approx *= c["scales"].astype(np.float32)
    flat = approx.ravel()
    flat[own[c["copies"][own % m] == 1]] = -np.inf
    slack = SLACK * (1 + dim // EXACT)
    error = q["residues"] * (1 + c["residues"].max()) + c["residues"].max() + slack
    bar = best.scores[first : first + n, -1].copy()
    if m > k and (new := np.flatnonzero(bar == -np.inf)).size:
        bar[new] = np.partition(approx[new], m - k, axis=1)[:, m - k] * q["scales"][new] - error[new]
    found = np.flatnonzero(approx >= ((bar - error) / q["scales"]).astype(np.float32)[:, None])
    for at in range(0, len(found), PAIRS_AT_ONCE):
        places = found[at : at + PAIRS_AT_ONCE]
        places = places[flat[places] > -np.inf]
        rows, cols = places // m, places % m
        upper = flat[places] * q["scales"][rows] + q["residues"][rows] * (1 + c["residues"][cols]) + c["residues"][cols] + slack
        kept = upper >= np.maximum(bar, best.scores[first : first + n, -1])[rows]
        places, rows, cols = places[kept], rows[kept], cols[kept]
        best.add(first + rows, c["ids"][cols], cosines(q["vectors"][rows].astype(np.float64), c["vectors"][cols].astype(np.float64)), c["copies"][cols] - np.isin(places, own))


def _side(row: dict, prefix: str) -> dict:
    n, dim = row[f"{prefix}n"].as_py(), row["c_dim"].as_py()
    read = lambda name, kind: np.frombuffer(row[f"{prefix}{name}"].as_buffer(), kind)
    wide = len(row[f"{prefix}vectors"].as_buffer()) == 8 * n * dim
    return {"ids": read("ids", np.int64), "hashes": read("hashes", np.int64), "copies": read("copies", np.int64), "vectors": read("vectors", np.float64 if wide else np.float32).reshape(n, dim), "codes": read("codes", np.int8).reshape(n, dim), "scales": read("scales", np.float64), "residues": read("residues", np.float64)}


def _tiles(k: int):
    """Of a task's tiles, the candidates of one block after those of another: k rows a query."""

    def run(batches):
        import pyarrow as pa

        best, last, c = {}, None, {}
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                if (block := row["c_block"].as_py()) != last:
                    last, c = block, {name: x.copy() for name, x in _side(row, "c_").items()}
                    c["columns"] = np.ascontiguousarray(c["codes"].T, np.float32)
                q = _side(row, "q_")
                if (block := row["q_block"].as_py()) not in best:
                    best[block] = (*(q[x].copy() for x in ("ids", "hashes", "copies")), Best(len(q["ids"]), k))
                tile(q, c, best[block][-1])
            batch = row = q = None  # else they hold it while the next is read
        for ids, hashes, copies, of in best.values():
            rows, places = np.nonzero(of.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[rows], hashes[rows], copies[rows], of.ids[rows, places], of.scores[rows, places])], names=["query_id", "query_hash", "query_copies", "vec_id", "score"])

    return run


def _stored(of: DataFrame, label: str) -> DataFrame:
    # row groups end after BLOCK_BYTES, looked at after each block: writers and readers hold as much at a time, however large a file is
    return written(of, label, **{"parquet.block.size": BLOCK_BYTES, "parquet.page.size.row.check.min": 1})


def tiles(vectors: DataFrame, queries: DataFrame, k: int, query_block: int, vector_block: int) -> DataFrame:
    """The k best candidates of each query in each share of the candidate blocks."""
    files = max(1, -(-queries.count() // (QUERY_BLOCKS * query_block)))
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    left = side(_stored(blocks(vectors, vector_block), "candidates").coalesce(SHARES), "c_")
    right = side(_stored(blocks(queries.repartition(files, "vec_id", "h"), query_block), "queries"), "q_")
    # the left side's blocks are read one after another, each beside all of the right side's share
    pairs = left.hint("shuffle_replicate_nl").join(right, F.col("c_dim") == F.col("q_dim"))
    return pairs.mapInArrow(_tiles(k), "query_id long, query_hash long, query_copies long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """vectors, queries: as usable() gives them. Rows: query_id, rank, vec_id, score."""
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    best = tiles(vectors, queries, k, query_block, vector_block).withColumn("rank", rank).where(F.col("rank") <= k)
    # a query row that is there several times is answered as often
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies"))).select("query_id", "rank", "vec_id", "score")


def search_report(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    vectors = usable(embeddings)
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.row as query_row, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(c.v, lambda x: x * x)))) as score
  from v q join v c on q.row <> c.row and len(q.v) = len(c.v) where q.vec_id % {every} = 0),
ranked as (select *, row_number() over (partition by query_row order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= {k}
"""
