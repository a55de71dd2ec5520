"""Line dedup across documents by a deletion-neighbourhood join.

A line (trimmed of blanks at both ends) goes if an earlier line, by (doc_id,
hash of the row's text, line number), is within one edit of it (insertion, deletion
or substitution), whatever its length. Blank lines stay. What an earlier
line is does not depend on whether that line stays itself, so the result does
not depend on order of work.

Emitting each line's variants at every position at once would multiply the text
by its line lengths, so the neighbourhood is emitted coarse to fine, each level
deleting a smaller part and only for lines that met another line before. For
lines A, B within one edit with M the longer length, common prefix and suffix
add up to at least M - 1; hence at every level some emitted key is equal:

  0. one half of the line deleted: the kept half's hash, one key per side;
  1. a segment of SEGMENT code points deleted: two hashes of what is left;
  2. inside a segment, one code point deleted: hashes of all variants.

Equal variants at one position mark substitutions, a variant equal to a whole
segment marks an insertion. Per variant only minima are kept, never pairs, and
the edit distance of the segments is verified before a line goes. Only first
occurrences have variants, so those of one variant differ in one code point and
its place: such a group is bounded however often a line repeats. Exact copies
are grouped by a 128-bit hash with partial aggregation; repeated lines are joined
to their occurrences from a table of their own, whose skew Spark can split.

Defined cases: null texts stay null; null doc_ids order first; rows that share
a doc_id are told apart by a hash of their texts, those with equal texts count as
one document; of rows without an id and with equal texts the first, by the other
columns, counts as the earlier document; lines end at line feeds only; an empty table gives no rows; other
columns are carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEGMENT = 16
BLANK = " \t\r"
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)


def _halves(line, n):
    """Level 0 keys of a trimmed line of n code points."""

    def keys(m):
        grid = F.when(m < 128, 4).otherwise(16)
        p = (grid * F.floor((m - 1) / (2 * grid))).cast("int")
        tag = F.floor(m / 8)
        return [F.xxhash64(F.lit(0), p, tag, F.substring(line, F.lit(1), p)), F.xxhash64(F.lit(1), p, tag, F.right(line, p))]

    return F.array_distinct(F.array(*keys(n), *keys(n + 1)))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: h1, h2, doc_id, row (hash of the text), line_no and its level 0 keys."""
    # hashed below the generator, or each line would carry the text and hash it again
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    n = F.length("line")
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc_id", "row", "line_no", _halves(F.col("line"), n).alias("halves"))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = pow(base, size, prime)
        k = min(size, n - size)
        out[size : size + k] = out[:k] * np.uint64(step) % np.uint64(prime)
        size += k
    return out


_POWERS: dict[int, list] = {}


def _tables(n: int) -> list:
    """Powers of each base and of its inverse, up to n, grown by doubling."""
    size = 1 << max(10, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = [(_powers(size, b, p), _powers(size, pow(b, -1, p), p)) for b, p in zip(BASES, PRIMES, strict=True)]
    return _POWERS[size]


def segment_rows(line: str) -> list[tuple[int, int, int, int, str]]:
    """Level 1: (key1, key2, deletes, deleted segment) for both lengths the pair's longer line can have.

    The keys hash what is left, that length and the segment's number; deletes
    says whether the line has that length itself.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums = []
    for (up, down), p in zip(_tables(n + 1), PRIMES, strict=True):
        sums.append((np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:n] % np.uint64(p)) % np.uint64(p)]), down, np.uint64(p)))
    out = []
    for m in (n, n + 1):
        a = np.minimum(np.arange(0, max(m - 1, 1) + SEGMENT, SEGMENT), m - 1)
        begin, end = a[:-1], n - ((m - 1) - a[1:])
        keys = []
        for total, down, p in sums:
            suffix = (total[n] + p - total[end]) % p * down[end] % p
            keys.append((total[begin] << np.uint64(31)) + suffix)
        keys[0] += np.arange(len(begin), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m * 0x7FB5D329728EA185 % (1 << 64))
        out += [(k1, k2, m == n, line[b:e]) for k1, k2, b, e in zip(keys[0].view(np.int64).tolist(), keys[1].view(np.int64).tolist(), begin.tolist(), end.tolist(), strict=True)]
    return out


def _segments(batches):
    for pdf in batches:
        out = []
        for doc_id, row, line_no, is_null, line in zip(pdf["doc_id"], pdf["row"], pdf["line_no"], pdf["is_null"], pdf["line"], strict=True):
            out += [(None if is_null else doc_id, row, line_no, *part) for part in segment_rows(line)]
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)
                out = []
        yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)


SEGMENT_COLUMNS = ["doc_id", "row", "line_no", "key1", "key2", "deletes", "mid"]


def near_dropped(docs: DataFrame, occ: DataFrame, first: DataFrame) -> DataFrame:
    """First occurrences (doc_id, row, line_no) of lines within one edit of an earlier line."""
    halves = occ.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
    met = halves.join(shared, "half", "left_semi").select("h1").distinct()
    places = first.join(met, "h1", "left_semi").select(F.col("at.doc_id").alias("p_id"), F.col("at.row").alias("p_row"), F.col("at.line_no").alias("line_no")).groupBy("p_id", "p_row").agg(F.collect_list("line_no").alias("line_nos"))
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(places.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row") == F.col("p_row")))
    lines = found.withColumn("lines", F.split("text", "\n", -1)).select("doc_id", "row", F.explode("line_nos").alias("line_no"), "lines")
    lines = lines.select("doc_id", "row", "line_no", F.col("doc_id").isNull().alias("is_null"), F.btrim(F.get("lines", F.col("line_no")), F.lit(BLANK)).alias("line"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    plain = lines.withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast(id_type))) if id_type in ("bigint", "int", "smallint") else lines
    parts = plain.mapInPandas(_segments, f"doc_id {id_type}, row long, line_no int, key1 long, key2 long, deletes boolean, mid string")
    key = ["key1", "key2"]
    several = parts.groupBy(*key).agg(F.min(F.xxhash64("mid")).alias("low"), F.max(F.xxhash64("mid")).alias("high")).where("low <> high").select(*key)
    parts = parts.join(several, key, "left_semi").withColumn("at", F.struct("doc_id", "row", "line_no", "mid"))
    # hashed with one key, compared with the other beside it: 128 bits of the line's rest, the segment and the place
    hashed = lambda v: F.xxhash64("key1", v)
    deleted = F.transform(F.sequence(F.lit(1), F.length("mid")), lambda i: F.struct(i.alias("pos"), hashed(F.concat(F.substring("mid", F.lit(1), i - 1), F.substring("mid", i + 1, F.length("mid")))).alias("variant")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), hashed(F.col("mid")).alias("variant")))
    rows = parts.withColumn("v", F.explode(F.when(F.col("deletes"), deleted).otherwise(whole))).select("key2", "at", "v.pos", "v.variant")
    same, same_pos = Window.partitionBy("key2", "variant"), Window.partitionBy("key2", "variant", "pos")
    rows = rows.withColumns({
        "whole_at": F.min(F.when(F.col("pos") == 0, F.col("at"))).over(same), "less_at": F.min(F.when(F.col("pos") > 0, F.col("at"))).over(same), "peer_at": F.min("at").over(same_pos),
    })
    # beside a row's own line: of equal deletions at one position the earliest, and whole segments against deletions
    options = F.array(F.when(F.col("pos") > 0, F.col("peer_at")), F.when(F.col("pos") > 0, F.col("whole_at")), F.when(F.col("pos") == 0, F.col("less_at")))
    ok = F.exists(options, lambda o: o.isNotNull() & (F.struct(o["doc_id"], o["row"], o["line_no"]) < F.struct(F.col("at.doc_id"), F.col("at.row"), F.col("at.line_no"))) & (F.levenshtein(o["mid"], F.col("at.mid")) == 1))
    return rows.where(ok).select("at.doc_id", "at.row", "at.line_no").distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no) of every line that goes; a line may come twice."""
    occ = written(occurrences(docs), "line-occurrences")
    first = occ.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("at"), F.count("*").alias("n"))
    repeated = written(first.where("n > 1").select("h1", "h2", "at"), "line-repeated")
    copies = occ.select("h1", "h2", "doc_id", "row", "line_no").join(repeated, ["h1", "h2"]).where(F.struct("doc_id", "row", "line_no") != F.col("at")).select("doc_id", "row", "line_no")
    return copies.unionAll(near_dropped(docs, occ, first))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text reduced to the lines that stay, _lines and _dropped (how many there were and went), and other columns in _rest."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", *([F.struct(*rest).alias("_rest")] if rest else []))
    # not written, so that Spark can read the exchange of texts by row twice, for the near lines and for the result
    gone = dropped_lines(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).agg(F.collect_set("line_no").alias("_gone"))
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    # rows without an id are documents of their own: all lines of a later one with the same text repeat the first one's
    keyless = keyed.where("doc_id is null")
    copied = not keyless.groupBy("_row").count().where("count > 1").isEmpty()
    if copied:
        nth = F.row_number().over(Window.partitionBy("_row").orderBy(F.to_json("_rest") if rest else F.lit(0)))
        keyed = keyed.where("doc_id is not null").withColumn("_again", F.lit(False)).unionAll(keyless.withColumn("_again", nth > 1))
    out = keyed.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left").drop("_gone_id", "_gone_row", "_row")
    lines = F.split("text", "\n", -1)
    if copied:
        every = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.btrim(F.get(lines, i), F.lit(BLANK)) != "")
        out = out.withColumn("_gone", F.when(F.col("_again") & F.col("text").isNotNull(), every).otherwise(F.col("_gone"))).drop("_again")
    count = F.size(lines)
    keep = F.array_except(F.sequence(F.lit(0), count - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    went = F.when(F.col("text").isNull() | F.col("_gone").isNull(), 0).otherwise(count - F.size(keep))
    out = out.withColumns({"_lines": F.when(F.col("text").isNull(), 0).otherwise(count), "_dropped": went, "_new": text})
    return out.withColumn("text", F.col("_new")).drop("_gone", "_new")


def line_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, text after dedup."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), "text")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs after dedup; those of which nothing but blanks is left go. n_chars follows the text."""
    out = dedup_lines(docs)
    out = out.where(~((F.col("_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", "")) == "")))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0))}
    return out.select([made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col("_rest")[c].alias(c) for c in docs.columns])
