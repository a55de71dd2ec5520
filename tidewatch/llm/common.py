"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a temporary one on a local master, which has one machine; an error on any other."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class _Scratch(threading.local):
    """Paths that this thread's run has made: runs in other threads keep theirs."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_scratch = _Scratch()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; remembered until it is deleted."""
    _scratch.paths.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _scratch.paths[-1]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _scratch.paths:
        _scratch.paths.remove(path)


def made_so_far() -> set[str]:
    return set(_scratch.paths)


def clear(spark: SparkSession, keep: set[str]) -> None:
    """Deletes what operators have left in the shared folder in this thread but for the paths to keep, once nothing reads it any more."""
    for path in [p for p in _scratch.paths if p not in keep]:
        _delete(spark, path)


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df as Parquet, with the writer's options, in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def slices(batch, column: str, most: int = 512, size: int = 4 << 20):
    """An Arrow batch in slices of at most `most` rows and about `size` bytes of a text column, one row at least: what a task holds as Python strings is bounded whatever the texts' length."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = min(len(batch), at + most, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


WORDS = 1 << 19


def perhaps_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose hash h is one of keys' (written, column h), and a few others: a Bloom filter, so that rows needn't be shuffled to leave out most.

    Each key sets four bits of one of at most WORDS words; more keys only let more other rows pass. Callers join what stays exactly.
    """
    words = 1
    while words < min(WORDS, keys.count() / 4):
        words *= 2
    word = F.col("h").bitwiseAND(F.lit(words - 1).cast("long")).alias("_word")
    bit = lambda at: f"shiftleft(1L, cast(shiftrightunsigned(h, {at}) & 63 as int))"
    mask = F.expr(" | ".join(bit(at) for at in (40, 46, 52, 58)))
    bits = keys.select(word, mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    return rows.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(bits), "_word").where("_bits & _mask = _mask").select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


EDGES = 1 << 18


def _forest(batches):
    """Star edges with the components of each EDGES edges, their smallest id as root."""
    import pyarrow as pa

    def stars(up, kinds):
        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        found = [(x, r) for x in up if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], kinds[k]) for k in (0, 1)], names=["a", "b"])

    up, n = {}, 0
    for whole in batches:
        kinds = [whole.schema.field(c).type for c in ("a", "b")]
        for at in range(0, len(whole), EDGES):
            b = whole.slice(at, EDGES)
            if n + len(b) > EDGES:
                yield stars(up, kinds)
                up, n = {}, 0
            n += len(b)
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                up.setdefault(x, x)
                up.setdefault(y, y)
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                while up[y] != y:
                    up[y] = up[up[y]]
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
    if up:
        yield stars(up, kinds)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, root), root the smallest id.

    First each task replaces its edges, EDGES at a time, by stars, then so do as
    many tasks as what is left needs. If that is more than one, large-star and
    small-star steps follow in turn, each one grouping by node, so a hub's
    neighbours are replaced by one row each and no pair list is built. Every
    round is written to the shared folder; it ends when no edge changes.
    """
    cur = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    contracted = lambda df: written(df.mapInArrow(_forest, df.schema), label)
    first = contracted(cur)
    tasks = max(1, -(-first.count() // EDGES))
    cur = contracted(first.coalesce(tasks))
    discard(first)
    while tasks > 1:
        # a star forest is the fixed point: no node is both a leaf and a root, no leaf has two roots
        n, leaves = cur.agg(F.count("*"), F.countDistinct("a")).first()
        if n == leaves and cur.join(cur.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt = written(small, label)
        discard(cur)
        cur = nxt
    out = cur.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    out._scratch = cur._scratch
    return out
