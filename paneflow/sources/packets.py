"""Packet rows: their schema, checks on loading, and a packet view over the `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the queries read of a packet. us: microseconds; seq: order among packets of one microsecond.
PACKETS = T.StructType(
    [
        T.StructField("us", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("src_ip", T.LongType(), False),
        T.StructField("dst_ip", T.LongType(), False),
        T.StructField("src_port", T.IntegerType(), False),
        T.StructField("dst_port", T.IntegerType(), False),
        T.StructField("proto", T.IntegerType(), False),
        T.StructField("tcp_flag", T.IntegerType(), False),
        T.StructField("size", T.LongType(), False),
    ]
)


def as_packets(df: DataFrame, complete: bool = True) -> DataFrame:
    """The packet columns of df in their types.

    The model knows no NULL. complete: rows that lack any of the columns are left out, which reads them all; otherwise each
    query leaves out the rows that lack what it needs, and reads only that.
    """
    if missing := [f.name for f in PACKETS if f.name not in df.columns]:
        raise ValueError(f"not packets, these columns are missing: {', '.join(missing)}")
    packets = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKETS))
    return packets.na.drop() if complete else packets


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic view of the events as packets, the same integers in any engine."""
    kinds = {"click": 2, "purchase": 17, "view": 16, "error": 1}
    flag = F.lit(18)
    for kind, value in kinds.items():
        flag = F.when(F.col("event_type") == kind, value).otherwise(flag)
    e = F.col("event_id")
    return as_packets(
        spark.read.parquet(f"{sf_dir}/events.parquet").select(
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            e.alias("seq"),
            F.col("user_id").alias("src_ip"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 20).alias("dst_ip"),
            (e % 64 + 1024).alias("src_port"),
            F.when(e % 4 == 0, 22).otherwise(1 + e % 50).alias("dst_port"),
            F.when(e % 10 == 9, 17).otherwise(6).alias("proto"),
            flag.alias("tcp_flag"),
            (40 + F.floor("value") % 8).alias("size"),
        ),
        complete=False,
    )


#: The same view in DuckDB's SQL.
PACKETS_SQL = """SELECT epoch_us(ts) AS us, event_id AS seq, user_id AS src_ip, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS dst_ip,
  CAST(event_id % 64 + 1024 AS INT) AS src_port, CAST(CASE WHEN event_id % 4 = 0 THEN 22 ELSE 1 + event_id % 50 END AS INT) AS dst_port,
  CASE WHEN event_id % 10 = 9 THEN 17 ELSE 6 END AS proto,
  CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 17 WHEN 'view' THEN 16 WHEN 'error' THEN 1 ELSE 18 END AS tcp_flag,
  40 + CAST(floor(value) AS BIGINT) % 8 AS size FROM events"""
