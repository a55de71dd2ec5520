"""Importance resampling towards a target corpus, by hashed word features.

Features of a text are its words and its pairs of consecutive words, each hashed
to one of BUCKETS buckets by crc32. Documents and target texts become posting
blocks by bucket. The postings are dealt by (group of buckets, part of the
blocks); the counts of both corpora meet by bucket, which gives each bucket's
gain floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), and the gains
of a group (a few numbers) meet the group's postings. There each posting gives
its document count times gain; contributions are summed in the task and then by
document. So the shuffle holds a posting once, in packed lists, and at most
GROUPS sums a document; the commonest bucket is spread over all parts.

A document's weight is the floored mean gain of its features; its score adds a
Gumbel number made of sha256 of seed and doc_id. Of the N documents with at least
LEAST_WORDS words the floor(SHARE N / 100) of highest score are drawn, without
replacement. Ranks come from a range sort by (score, doc_id, row): a row's place
within its sorted part on top of the sizes of the parts before.

Defined cases: null and empty texts have no features and weight 0; a null doc_id
hashes as an empty one and loses ties; rows that share a doc_id are documents of
their own with the same random number, equal rows get ranks one after the other;
without targets T = t = 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written
from .postings import blocks, headed, inverted, lists, numbered_rows, words

BUCKETS, GROUPS, BLOCKS_A_PART = 10_000, 64, 16
LEAST_WORDS, SHARE, SEED = 20, 25, 7


def buckets(found: list[bytes]) -> np.ndarray:
    """Buckets of the words and of the pairs of consecutive words, repeats included."""
    known: dict[bytes, int] = {}
    singles = []
    for w in found:
        if (c := known.get(w)) is None:
            c = known[w] = crc32(w)
        singles.append(c)
    # a checksum goes on where the one of the first word ended
    pairs = [crc32(b" " + w, c) for c, w in zip(singles, found[1:])]  # noqa: B905
    return np.array(singles + pairs, np.int64) % BUCKETS


def _featured(batches):
    for first, ids, texts in blocks(batches):
        found = [words(t) for t in texts]
        n_words = np.array([len(f) for f in found], np.int32)
        key, begin, docs, counts = inverted([buckets(f) for f in found], BUCKETS)
        # the block's documents come first, as a row without a bucket: words as docs, features as counts
        offsets = np.concatenate([[0], begin + len(texts)])
        features = np.maximum(0, 2 * n_words - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key) + 1, first, np.int64)), pa.array([None, *key.tolist()], pa.int32()), lists(offsets, np.concatenate([n_words, docs])), lists(offsets, np.concatenate([features, counts])), headed(ids, len(key) + 1)],
            names=["block", "bucket", "docs", "counts", "ids"],
        )


def feature_postings(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered_rows(docs).mapInArrow(_featured, f"block long, bucket int, docs array<int>, counts array<int>, ids array<{kind}>")


def bucket_gains(posts: DataFrame, target_posts: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets that the documents hold; both corpora's counts meet by bucket."""
    total = lambda x, name: x.where("bucket is not null").groupBy("bucket").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias(name))
    both = total(posts, "s").join(total(target_posts, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    every = Window.partitionBy()  # at most BUCKETS rows
    whole = both.withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    ratio = F.expr(f"((t + 1) * cast(all_s + {BUCKETS} as double)) / ((s + 1) * cast(all_t + {BUCKETS} as double))")
    return whole.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(posts: DataFrame, gains: DataFrame, parts: int) -> DataFrame:
    """(block, pos, total): the summed gains of each document's features."""
    held = posts.where("bucket is not null").select("block", F.expr(f"bucket % {GROUPS}").alias("group"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.expr(f"bucket div {GROUPS}").cast("int").alias("place"), "docs", "counts")
    # BUCKETS / GROUPS gains a row
    local = gains.groupBy(F.expr(f"bucket % {GROUPS}").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"bucket div {GROUPS}").cast("int"), "gain"))).alias("gains"))
    local = local.select("group", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // GROUPS)), lambda k: F.coalesce(F.element_at("gains", k), F.lit(0))).alias("gains"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    met = held.join(local.hint("shuffle_hash"), ["group", "part"]).select("block", F.get("gains", F.col("place")).alias("gain"), F.explode(F.arrays_zip("docs", "counts")).alias("p"))
    return met.select("block", F.col("p.docs").alias("pos"), (F.col("gain") * F.col("p.counts")).alias("c")).groupBy("block", "pos").agg(F.sum("c").alias("total"))


def ranked(df: DataFrame, order: list, name: str) -> tuple[DataFrame, DataFrame]:
    """df with its row numbers in order (no ties), and the table they are read from: places within range-sorted parts on top of the parts before."""
    place = F.monotonically_increasing_id()
    x = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), (place - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_place"))
    x = written(x, "ranked")
    # a row per part
    ahead = x.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    return x.join(F.broadcast(ahead), "_range").withColumn(name, F.col("_ahead") + F.col("_place") + 1).drop("_range", "_place", "_ahead"), x


def resample(docs: DataFrame, targets: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (null if not drawn)."""
    posts = written(feature_postings(docs), "feature-postings")
    gains = bucket_gains(posts, feature_postings(targets.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    of_docs = posts.where("bucket is null")
    parts = max(1, -(-of_docs.count() // BLOCKS_A_PART))
    rows = of_docs.select("block", F.posexplode(F.arrays_zip("ids", "docs", "counts")).alias("pos", "d")).select("block", "pos", F.col("d.ids").alias("doc_id"), F.col("d.docs").alias("n_words"), F.col("d.counts").cast("long").alias("n_features"))
    x = rows.join(weights(posts, gains, parts), ["block", "pos"], "left")
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features"))
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    x = x.withColumn("weight", weight.cast("long")).withColumn("score", F.col("weight") + noise).drop("total")
    order = [F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("block"), F.asc("pos")]
    x, table = ranked(x, order, "_rank")
    drawn = share * table.where(F.col("n_words") >= least_words).count() // 100
    out = written(x.select("doc_id", "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank")), "resampled")
    discard(posts, table)
    return out


def draw(docs: DataFrame, targets: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs whose doc_id was drawn."""
    kept = resample(docs, targets, share, least_words, seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def oracle() -> str:
    # the table of crc32 by its rule: eight shifts of each byte, folded with the reversed polynomial
    bit = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    words_of = lambda t, i: f"select {i} as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {t}"
    feats = lambda t: f"select id, unnest(w) as f from {t} union all select id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) from {t} where len(w) > 1"
    return f"""
with recursive shifted as (select range as b, range as v, 0 as k from range(256) union all select b, {bit}, k + 1 from shifted where k < 8),
crc as (select list(v order by b) as t from shifted where k = 8),
d as ({words_of("documents", "doc_id")}), q as ({words_of("benchmark", "item_id")}),
df as (select id, f, count(*) as n from ({feats("d")}) group by all), qf as (select f, count(*) as n from ({feats("q")}) group by all),
named as (select f, list_transform(range(0, (length(hex(encode(f))) // 2)::bigint), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint) as bytes from (select f from df union select f from qf)),
hashed as (select f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from named, crc),
s as (select bucket, sum(n)::bigint as s from df join hashed using (f) group by bucket), t as (select bucket, sum(n)::bigint as t from qf join hashed using (f) group by bucket),
gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((select sum(s) from s) + {BUCKETS})::double) / ((s + 1) * ((select coalesce(sum(t), 0) from t) + {BUCKETS})::double)))::bigint as gain
  from s left join t using (bucket)),
sums as (select id, sum(n * gain)::bigint as total, sum(n)::bigint as n from df join hashed using (f) join gains using (bucket) group by id),
weighed as (
  select d.id as doc_id, len(d.w) as n_words, coalesce(n, 0) as n_features, case when n is null then 0 else (total - ((total % n) + n) % n) // n end as weight,
    ('0x' || substr(sha256('{SEED}:' || d.id), 1, 8))::bigint as h
  from d left join sums using (id)),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
ranked as (select *, row_number() over (order by n_words >= {LEAST_WORDS} desc, score desc, doc_id) as r, (select {SHARE} * count(*) // 100 from scored where n_words >= {LEAST_WORDS}) as drawn from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when r <= drawn then r end as rank from ranked"""
