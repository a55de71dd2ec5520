"""Times, scores, labels and tolerant decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_FACTOR = 0.6745  # fixed value of the modified z-score


def parse_time(text: Column) -> Column:
    """UTC instant of ISO text with Z, +0000, +02:00 or no offset (then UTC); null for junk."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def window_floor(us: Column, seconds: int) -> Column:
    """Epoch second at which an event's tumbling window begins."""
    return F.floor(us / F.lit(1_000_000 * seconds)).cast("long") * seconds


def whole_seconds(begin_us: Column, end_us: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((end_us - begin_us) / 1_000_000)).cast("long")


def scale_of(mad: Column, global_mad: Column, median: Column) -> Column:
    """Own MAD, else the global one, else a tenth of the median, at least 1."""
    return F.when(mad > 0, mad).when(global_mad > 0, global_mad).otherwise(F.greatest(F.lit(1.0), F.abs(median) * 0.1))


def modified_z(x: Column, median: Column, scale: Column) -> Column:
    """One-sided: 0 up to the median."""
    return F.when(x <= median, F.lit(0.0)).otherwise(F.lit(Z_FACTOR) * (x - median) / F.when(scale <= 0, F.lit(1.0)).otherwise(scale))


def anomaly_id(detector: str, src: Column, start: Column, seconds: int, metric: Column) -> Column:
    return F.concat(F.lit("ANOM-"), F.upper(F.substring(F.sha1(F.concat_ws("|", F.lit(detector), src, start, F.lit(str(seconds)), metric)), 1, 12)))


def hour_angle(us: Column) -> Column:
    """Time of day in UTC as an angle; whole seconds count."""
    return F.pmod(F.floor(us / 1_000_000), F.lit(86400)) * F.lit(2 * 3.141592653589793 / 86400)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[ \\-/]", "_")


def priority_level(score: Column) -> Column:
    return F.when(score < 33, "Low").when(score < 66, "Medium").otherwise("High")


def json_ids(text: Column) -> Column:
    """Integers of a JSON list, exact up to 64 bits; also of forms like 1.0; an empty list for junk."""
    return F.coalesce(F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: x.try_cast("decimal(38,10)").try_cast("long")), lambda x: x.isNotNull()), F.array().cast("array<long>"))


def round2(x: Column) -> Column:
    """Two decimals by the exact binary value, ties to even, as the product with 100 and its rounding error decide."""
    p, low = x * 100.0, x * 134217729.0
    high = low - (low - x)
    error = (high * 100.0 - p) + (x - high) * 100.0
    down = F.floor(p).cast("double")
    up = (error > 0) | (error == 0) & (F.pmod(down, F.lit(2.0)) == 1)
    return F.when(p - down == 0.5, down + F.when(up, 1.0).otherwise(0.0)).otherwise(F.rint(p)) / 100.0


def or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def int_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def or_na(c: Column) -> Column:
    """Display form: N/A for null, numbers without decimals."""
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def id_of(prefix: str, n: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", n)
