"""Stored tables: scans and idempotent writes."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS, ContractError, require_columns

LIGHT = ("id", "us", "flow_id", "src_ip", "dest_ip", "dest_port")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a temporary one on a local master, which has one machine; an error on any other."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class _Scratch(threading.local):
    """What this thread's run has stored: runs in other threads keep theirs."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_scratch = _Scratch()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage, and saves computing df twice, through a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what stored() has made in this thread, once nothing reads it any more."""
    while _scratch.paths:
        delete(spark, _scratch.paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CURRENT, RUNS = "_current", "_runs"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def published(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """Where the derived tables of the last published runs are: table to part to folder below root."""
    fs, path = _fs(spark, f"{root}/{CURRENT}")
    if not fs.exists(path):
        return {}
    stream = fs.open(path)
    try:
        return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
    finally:
        stream.close()


def new_run() -> str:
    """A folder below root for the tables of one run; nobody reads it until it is published."""
    return f"{RUNS}/{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, run: str, names, part: str = "") -> None:
    """Makes a run's tables the current ones, all at once: readers find tables by one file, and one rename replaces it.

    A run may be one part of its tables (a window length) beside others. Folders of
    runs that neither this file nor the one before it names are deleted, so what a
    reader has begun to read stays for one more run. One writer at a time.
    """
    before = published(spark, root)
    after = before | {n: {**(before.get(n, {}) if part else {}), part: f"{run}/{n}"} for n in names}
    fs, path = _fs(spark, f"{root}/{CURRENT}")
    _, temporary = _fs(spark, f"{root}/{CURRENT}-{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    stream.write(bytearray(json.dumps(after, indent=1, sort_keys=True).encode()))
    stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, path, how)
    kept = {p.split("/")[1] for parts in [*before.values(), *after.values()] for p in parts.values()}
    _, runs = _fs(spark, f"{root}/{RUNS}")
    for status in fs.listStatus(runs):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def scan(spark: SparkSession, root: str, table: str, columns=None, where: str | None = None) -> DataFrame:
    """A stored table; columns and filters reach the Parquet scan."""
    parts = published(spark, root).get(table)
    df = spark.read.parquet(*([f"{root}/{p}" for p in parts.values()] if parts else [f"{root}/{table}"]))
    if where:
        df = df.where(where)
    return require_columns(df, columns, table).select(*columns) if columns else df


def append(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None) -> int:
    """Adds rows whose keys are known to be new, without a shuffle; returns how many."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{table}")
    return seen.get["rows"]


def append_new(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None, among: str | None = None) -> int:
    """Insert-or-ignore by the table's key; returns how many rows were new.

    among: a condition that all stored rows meet which may share a key with df; it
    reaches the scan, so that other stored files aren't read.
    """
    spark, path, keys = df.sparkSession, f"{root}/{table}", list(KEYS[table])
    require_columns(df, keys, table)
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        stored_keys = spark.read.parquet(path)
        new = new.join((stored_keys.where(among) if among else stored_keys).select(*keys), keys, "left_anti")
    return append(new, root, table, partition_by)


def replace(df: DataFrame, root: str, table: str) -> None:
    """The whole table anew; df must not read it."""
    df.write.mode("overwrite").parquet(f"{root}/{table}")


def store_cases(case_rows: DataFrame, links: DataFrame, findings: DataFrame, root: str) -> None:
    """Cases and their links, once every linked finding exists."""
    lost = links.join(findings.select("finding_id"), "finding_id", "left_anti")
    if not lost.isEmpty():
        raise ContractError(f"cases name missing findings: {', '.join(sorted(r.finding_id for r in lost.limit(5).collect()))}")
    replace(case_rows, root, "cases")
    replace(links, root, "case_findings")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; lists become text joined by "; "."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
