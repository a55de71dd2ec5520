"""Range windows and gaps-and-islands that spread a hot key over time buckets.

A window function over one key runs in one task, so a key with a third of the
rows would stop the rest. Here rows of a key are dealt to buckets of time; rows
near a border also go to the neighbour, where they are seen but not returned.

Frames that slide at both ends are aggregated anew for each row, so none is used:
every count is a difference of running ones, whose frames only grow, and a burst
costs in proportion to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

BUCKET_WIDTHS = 16
#: Lengths of buckets for ranges of any length: an hour, and 16 times the one before.
LEVEL_US, LEVELS = 3_600_000_000, 6


def bucket_of(at: Column, level: Column) -> Column:
    """The bucket of a level in which a time lies."""
    return F.floor(at / (F.lit(LEVEL_US) * F.pow(F.lit(16.0), level))).cast("long")


def in_buckets(df: DataFrame, begin: str, end: str) -> DataFrame:
    """df with _level and _bucket: a range stands in the one or two buckets it touches of the shortest level that is as long, so that a time within it lies in one of them.

    Ranges beyond the last level stand in as many buckets of it as they touch.
    """
    length = F.col(end) - F.col(begin)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= LEVEL_US * 16**k, F.lit(k)).otherwise(level)
    x = df.where(F.col(begin) <= F.col(end)).withColumn("_level", level)
    return x.withColumn("_bucket", F.explode(F.sequence(bucket_of(F.col(begin), F.col("_level")), bucket_of(F.col(end), F.col("_level")))))


def counted(df: DataFrame, key: str, at: str, width: int, name: str = "value") -> DataFrame:
    """df with the number of rows of its key in [at, at + width], peers included."""
    size = BUCKET_WIDTHS * max(1, width)
    floor = lambda c: F.floor(c / F.lit(size)).cast("long")
    wide = df.withColumn("_bucket", F.explode(F.sequence(floor(F.col(at) - width), floor(F.col(at)))))
    w = Window.partitionBy(key, "_bucket").orderBy(at)
    return wide.withColumn(name, _ahead(w, width)).where(F.col("_bucket") == floor(F.col(at))).drop("_bucket")


def _ahead(w, width: int) -> Column:
    """Rows from the current one's peers to those a width later."""
    before = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return F.count("*").over(w.rangeBetween(Window.unboundedPreceding, width)) - before


def _distinct_ahead(df: DataFrame, keys: list[str], at: str, width: int, value: str, name: str) -> DataFrame:
    """df with the number of distinct values, nulls left out, of its keys in [at, at + width].

    An occurrence is the first of its value for all windows that begin after the
    value's previous occurrence and no later than itself, a width before it at
    most. Each occurrence so opens at a point and closes behind itself, and a
    window's number is what has opened up to its begin less what has closed.
    """
    same = Window.partitionBy(*keys).orderBy(value, at)
    previous = F.when(F.lag(value).over(same) == F.col(value), F.lag(at).over(same))
    df = df.withColumn("_from", F.greatest(previous + 1, F.col(at) - width))
    row = lambda p, o, c: F.struct(p.alias("_pos"), o.cast("int").alias("_opens"), c.cast("int").alias("_closes"))
    holds = F.col(value).isNotNull()
    both = F.array(row(F.col(at), F.lit(0), holds), F.when(holds, row(F.col("_from"), F.lit(1), F.lit(0))))
    x = df.withColumn("_e", F.explode(F.array_compact(both))).select("*", "_e.*").drop("_e")
    # peers open and close at one point: a frame by range takes all of them, or none
    w = Window.partitionBy(*keys).orderBy("_pos")
    opened, closed = F.sum("_opens").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum("_closes").over(w.rangeBetween(Window.unboundedPreceding, -1))
    return x.withColumn(name, opened - F.coalesce(closed, F.lit(0))).where("_opens = 0").drop("_pos", "_opens", "_closes", "_from")


def islands(df: DataFrame, key: str, start: str, end: str, size: int, name: str = "island") -> DataFrame:
    """df with the start of each row's island: a row begins one if its start lies after every end before it.

    Rows are ordered by start; ties belong together. Two levels: inside buckets
    of size, and over one summary row per bucket.
    """
    x = df.withColumn("_bucket", F.floor(F.col(start) / F.lit(size)).cast("long"))
    inside = Window.partitionBy(key, "_bucket").orderBy(start)
    above = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(key, "_bucket").agg(F.max(end).alias("_e")).withColumn("_end_before", F.max("_e").over(above)).drop("_e")
    x = _with(x, ends, key)
    earlier = F.max(end).over(inside.rangeBetween(Window.unboundedPreceding, -1))
    before = F.greatest(earlier, F.col("_end_before"))
    x = x.withColumn("_first", F.when(before.isNull() | (F.col(start) > before), F.col(start)))
    firsts = x.groupBy(key, "_bucket").agg(F.max("_first").alias("_f")).withColumn("_first_before", F.max("_f").over(above)).drop("_f")
    x = _with(x, firsts, key)
    return x.withColumn(name, F.coalesce(F.max("_first").over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.col("_first_before"))).drop("_bucket", "_end_before", "_first_before", "_first")


def _with(x: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    right = summary.withColumnsRenamed({key: "_key", "_bucket": "_b"})
    return x.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")), "left").drop("_key", "_b")


def chained(df: DataFrame, key: str, at: str, width: int, threshold: int, distinct: str | None = None) -> DataFrame:
    """Member rows of episodes: adds episode (its start), value and window_end; both null where a row's own window does not qualify.

    A row's window is [at, at + width]; its value is the number of rows in it, or
    of distinct values of a column. It qualifies when the value reaches the
    threshold, and ends at its last row. Qualifying windows chain while the next
    starts no later than the last one's end; a row is a member of the last
    episode with a qualifying start at most a width ago.

    All windows share one partitioning by key and bucket, and all frames begin
    with the bucket, so each is one pass: ends of windows don't decrease with
    their starts, which makes the greatest end before a row the last one, and the
    last qualifying row up to a row decides membership. A bucket also sees two
    widths before it (its episodes' starts depend on them) and one after (its
    windows do); what lies further back comes as one row per bucket. Buckets with
    fewer rows than the threshold hold no window that qualifies and go first.
    """
    size = BUCKET_WIDTHS * width
    floor = lambda c: F.floor(c / F.lit(size)).cast("long")
    wide = df.withColumn("_bucket", F.explode(F.sequence(floor(F.col(at) - width), floor(F.col(at) + 2 * width))))
    wide = wide.withColumn("_rows", F.count("*").over(Window.partitionBy(key, "_bucket"))).where(F.col("_rows") >= threshold).drop("_rows")
    w = Window.partitionBy(key, "_bucket").orderBy(at)
    growing = lambda end: w.rangeBetween(Window.unboundedPreceding, end)
    seen = _distinct_ahead(wide, [key, "_bucket"], at, width, distinct, "value") if distinct else wide.withColumn("value", _ahead(w, width))
    seen = seen.withColumn("window_end", F.max(at).over(growing(width)))
    hit = F.col("value") >= threshold
    seen = seen.withColumns({"value": F.when(hit, F.col("value")), "window_end": F.when(hit, F.col("window_end"))})
    before = F.max("window_end").over(growing(-1))
    begins = F.col("window_end").isNotNull() & (F.col(at) >= F.col("_bucket") * size - width) & (before.isNull() | (before < F.col(at)))
    seen = seen.withColumn("_start", F.when(begins, F.col(at)))
    own = floor(F.col(at)) == F.col("_bucket")
    last = seen.groupBy(key, "_bucket").agg(F.max(F.when(own, F.col("_start"))).alias("_last"))
    above = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(key, "_bucket", F.max("_last").over(above).alias("_before"))
    x = seen.join(last, [key, "_bucket"])
    hits = F.when(F.col("window_end").isNotNull(), F.col(at))
    x = x.withColumns({"_hit": F.max(hits).over(growing(0)), "_island": F.coalesce(F.max("_start").over(growing(0)), F.col("_before"))})
    # an island goes on until the next begins, so the one of the last qualifying row is the last begun
    x = x.withColumn("episode", F.when(F.col("_hit") >= F.col(at) - width, F.col("_island")))
    return x.where(own & F.col("episode").isNotNull()).drop("_bucket", "_start", "_before", "_island", "_hit")


def numbered(df: DataFrame, name: str, group: list[Column], coarse: Column, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """df with 1, 2, ... in the order of group and then order, anew for each value of the columns within.

    Rows are numbered inside their group, on top of the sizes of earlier groups:
    one row per group is summed inside coarse, and one per coarse in one task.
    coarse must not decrease along group and have few values, such as months. df
    is read twice: store what is dear.
    """
    own = [f"_g{k}" for k in range(len(group))]
    names = [*within, *own]
    x = df.withColumns({**dict(zip(own, group, strict=True)), "_coarse": coarse})
    sizes = x.groupBy(*names, "_coarse").agg(F.count("*").alias("_n"))
    top = F.sum("_n").over(Window.partitionBy(*within).orderBy(F.asc_nulls_first("_coarse"))) - F.col("_n")
    tops = sizes.groupBy(*within, "_coarse").agg(F.sum("_n").alias("_n")).select(*[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], F.col("_coarse").alias("_c"), top.alias("_top"))
    inside = F.sum("_n").over(Window.partitionBy(*within, "_coarse").orderBy(*[F.asc_nulls_first(n) for n in own])) - F.col("_n")
    met = F.col("_coarse").eqNullSafe(F.col("_c"))
    for k, c in enumerate(within):
        met = met & F.col(c).eqNullSafe(F.col(f"_w{k}"))
    offsets = sizes.withColumn("_inside", inside).join(tops if within else F.broadcast(tops), met)  # few by contract, for each value within
    offsets = offsets.select(*[F.col(n).alias(f"{n}_") for n in names], (F.col("_inside") + F.col("_top")).alias("_ahead"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    row = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return x.join(offsets, same).withColumn(name, (row + F.col("_ahead")).cast("long")).drop(*own, *[f"{n}_" for n in names], "_coarse", "_ahead")


def by_time(df: DataFrame, name: str, us: str, order: list[Column], seconds: int = 600, within: tuple[str, ...] = ()) -> DataFrame:
    """df numbered by time and then order: groups of some minutes, months as coarse."""
    return numbered(df, name, [F.floor(F.col(us) / (seconds * 1_000_000)).cast("long")], F.floor(F.col(us) / (30 * 86_400_000_000)).cast("long"), [F.col(us), *order], within)


def accumulated(df: DataFrame, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """df with running sums, up to and with each row, in an order without ties.

    Rows are dealt by range of the order and stored; a part's sums run inside it,
    on top of those of the parts before, which are one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumns({f"_v_{n}": c for n, c in columns.items()}).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    x = stored(x, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = x.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_a_{n}") for n in columns])
    ahead = ahead.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_a_{n}").over(before), F.lit(0)).alias(f"_a_{n}") for n in columns])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(F.broadcast(ahead), F.col("_range") == F.col("_r"))  # a row per part
    return x.withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_a_{n}") for n in columns}).select(*df.columns, *columns)
