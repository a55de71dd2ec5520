"""The driver's events table read as network events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every column as a SQL expression both engines understand, but for two with a form of their own.
COLUMNS = {
    "id": "event_id", "event_type": "case event_type when 'error' then 'alert' else event_type end",
    "flow_id": "event_id - event_id % 2", "src_ip": "case when user_id % 7 = 0 then concat('192.168.0.', cast(user_id % 250 as varchar(9))) else concat('10.0.', cast(user_id % 250 as varchar(9)), '.7') end",
    "src_port": "cast(1024 + event_id % 50 as int)", "dest_ip": "concat('192.168.0.', cast(k % 10 as varchar(9)))", "dest_port": "cast(k as int)", "proto": "case k % 3 when 0 then 'UDP' else 'TCP' end",
    "app_proto": "case k % 4 when 0 then 'ftp' when 1 then 'http' else null end", "alert_sid": "case event_type when 'error' then 2000000 + k end", "alert_signature": "case event_type when 'error' then concat('Probe of port ', cast(k as varchar(9))) end",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, us, flow_start_us, flow_end_us and COLUMNS; value (seconds) is how long a flow lasts."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null")
    x = raw.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return x.selectExpr("us", "us as flow_start_us", "us + cast(floor(value) as bigint) * 1000000 as flow_end_us", *[f"{e} as {c}" for c, e in COLUMNS.items()])


SQL = (
    "select us, us as flow_start_us, us + cast(floor(value) as bigint) * 1000000 as flow_end_us, " + ", ".join(f"{e} as {c}" for c, e in COLUMNS.items())
    + " from (select event_id, user_id, event_type, value, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_id is not null)"
)
