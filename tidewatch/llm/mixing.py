"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target by water-filling its weight under a repeat limit.
Each document's expected number of copies, target / source size, is prefix
summed within its source, one offset drawn from the source's name is added, and
a document is emitted once per integer boundary its interval crosses.

Documents are ordered by (bit length of size, salt, size, id), so neighbours in
the prefix sum have like sizes and the words taken stay within about one long
document of the target. The prefix sum has two levels: counts per (source, bit
length, salt), summed within the source, and row numbers inside these buckets;
a hot source is thereby spread over salts times bit lengths tasks. Only the
summary of one row per source is ordered globally.

Defined cases: null texts have size 0, null sources form one source ordered
last, a source of size 0 has target 0, repeated rows are documents of their own,
an empty table gives no rows, and other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, REPEAT, SALTS, PER_SALT = (5, 2, 1), 3, 64, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salts_for(rows: int) -> int:
    """SALTS, doubled until a salt holds PER_SALT rows of all at most."""
    salts = SALTS
    while salts * PER_SALT < rows:
        salts *= 2
    return salts


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, repeat: int = REPEAT) -> DataFrame:
    """sizes: (_null, _source, _size) a row per document; gives a row per source with its target."""
    per = sizes.groupBy("_null", "_source").agg(F.sum("_size").alias("_total"))
    by_name = Window.orderBy("_null", "_source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("_weight", w)
    every = Window.orderBy("_cap", "_null", "_source")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_cap", F.col("_total") * repeat / F.col("_weight"))
    level = (F.sum("_total").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_total").over(before), F.lit(0)) * repeat) / F.sum("_weight").over(rest)
    per = per.withColumn("_level", level)
    level = F.first(F.when(F.col("_level") <= F.col("_cap"), F.col("_level")), ignorenulls=True).over(whole)
    target = F.least(F.col("_total") * F.lit(float(repeat)), F.coalesce(level * F.col("_weight"), F.lit(float("inf"))))
    return per.select("_null", "_source", "_total", target.alias("_target"))


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, repeat: int = REPEAT, salts: int | None = None, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, _size, _tie (orders what is equal in these) and any more columns; adds _total, _target and _copies."""
    salts = salts or salts_for(docs.count())
    hex_of = lambda s, n: F.conv(F.substring(F.md5(s), 1, n), 16, 10).cast("long")
    keyed = docs.withColumns({
        "_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit("")), "_bits": F.length(F.bin("_size")),
        "_salt": hex_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4 if salts <= 1 << 16 else 12) % salts,
    })
    buckets = keyed.groupBy("_null", "_source", "_bits", "_salt").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size"))
    targets = source_targets(buckets, weights, share, repeat)
    prior = Window.partitionBy("_null", "_source").orderBy("_bits", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = (hex_of(F.concat(F.lit(seed), F.when(F.col("_null"), "-").otherwise("+"), F.col("_source")), 5) + 0.5) / float(1 << 20)
    plan = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n", "_size").join(targets, ["_null", "_source"])
    plan = plan.withColumns({"_each": F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0), "_offset": offset})
    keys = ["_null", "_source", "_bits", "_salt"]
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("_size", "doc_id", "_tie"))
    out = keyed.join(plan, keys).withColumn("_at", at)
    crossed = F.floor(F.col("_at") * F.col("_each") + F.col("_offset")) - F.floor((F.col("_at") - 1) * F.col("_each") + F.col("_offset"))
    return out.withColumn("_copies", crossed.cast("long")).drop(*keys, "_before", "_each", "_offset", "_at")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, copies."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.lit(0).alias("_tie")), "mix-sizes")
    out = with_copies(sizes, **options)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns."""
    names = docs.columns
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    packed = packed.withColumn("_tie", F.xxhash64("_row"))
    out = with_copies(packed, **options).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select([F.col("_row")[c].alias(c) for c in names])


def oracle(weights=WEIGHTS, share: float = 1.0, repeat: int = REPEAT, salts: int = SALTS, seed: str = "mix") -> str:
    w = "[" + ", ".join(map(str, weights)) + "]"
    return rf"""
with sized as (
  select doc_id, source is null as s_null, coalesce(source, '') as s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 4))::bigint % {salts} as salt from documents),
per as (select s_null, s, sum(size)::bigint as total from sized group by all),
weighed as (select *, {w}[((row_number() over (order by s_null, s) - 1) % {len(weights)} + 1)::int] as weight from per),
capped as (select *, total * {repeat} / weight as cap from weighed),
levels as (select *, (sum(total) over () * {float(share)}::double - coalesce(sum(total) over (order by cap, s_null, s rows between unbounded preceding and 1 preceding), 0) * {repeat})
    / sum(weight) over (order by cap, s_null, s rows between current row and unbounded following) as level from capped),
targets as (select s_null, s, total, least(total * {float(repeat)}::double, coalesce((select level from levels where level <= cap order by cap, s_null, s limit 1) * weight, 'inf'::double)) as target from levels),
placed as (select *, row_number() over (partition by s_null, s order by length(bin(size)), salt, size, doc_id nulls first) as pos from sized),
copied as (select doc_id, size, total, target, case when total > 0 then target / total else 0 end as step, pos,
    (('0x' || substr(md5('{seed}' || case when s_null then '-' else '+' end || s), 1, 5))::bigint + 0.5::double) / 1048576::double as shift
  from placed join targets using (s_null, s))
select doc_id, size, total as source_size, target, (floor(pos * step + shift) - floor((pos - 1) * step + shift))::bigint * size as taken,
  (floor(pos * step + shift) - floor((pos - 1) * step + shift))::bigint as copies from copied
"""
