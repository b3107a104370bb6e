"""Raw packet traces as a Spark data source: files of packed 36-byte records, read and written in byte ranges."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The record's fields, little-endian and packed.
RECORD = np.dtype(
    [
        ("src_ip", "<u4"), ("dst_ip", "<u4"), ("src_port", "<u2"), ("dst_port", "<u2"), ("proto", "u1"), ("size", "<i4"),
        ("tcp_ack", "<u4"), ("tcp_seq", "<u4"), ("tcp_flag", "u1"), ("pkt_ts", "<f8"), ("ip_hdr_size", "u1"), ("tcp_hdr_size", "u1"),
    ]
)
_SCHEMA = (
    "src_ip long, dst_ip long, src_port int, dst_port int, proto int, size int, tcp_ack long, tcp_seq long, "
    "tcp_flag int, pkt_ts double, ip_hdr_size int, tcp_hdr_size int, seq long"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
#: Records of one read partition.
RECORDS = 1 << 20


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int
    seq: int


@dataclass
class _Written(WriterCommitMessage):
    path: str


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if not x.startswith((".", "_")))
    return [path]


class TraceReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self):
        out, seq = [], 0
        for path in _files(self.path):
            size = os.path.getsize(path)
            if size % RECORD.itemsize:
                raise ValueError(f"{path}: {size} bytes are not a whole number of {RECORD.itemsize}-byte records")
            n = size // RECORD.itemsize
            out += [_Range(path, i, min(self.records, n - i), seq + i) for i in range(0, n, self.records)]
            seq += n
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        rows = np.fromfile(partition.path, RECORD, partition.count, offset=partition.first * RECORD.itemsize)
        columns = [x.split() for x in _SCHEMA.split(", ")]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            seq = np.arange(partition.seq + at, partition.seq + at + len(part))
            arrays = [pa.array(seq if name == "seq" else part[name].astype(_ARROW[kind].to_pandas_dtype()), _ARROW[kind]) for name, kind in columns]
            yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in columns])


class TraceWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        os.makedirs(path, exist_ok=True)
        self.old = _files(path) if overwrite else []  # removed when the job has succeeded

    def write(self, iterator):
        name = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(name, "wb") as out:
            block = []
            for row in iterator:
                block.append(tuple(row[c] for c in RECORD.names))
                if len(block) == 1 << 14:
                    out.write(np.array(block, RECORD).tobytes())
                    block = []
            out.write(np.array(block, RECORD).tobytes())
        return _Written(name)

    def commit(self, messages):
        for x in self.old:
            os.remove(x)
        for i, m in enumerate(x for x in messages if x):
            os.rename(m.path, os.path.join(self.path, f"part-{i:05d}-{uuid.uuid4().hex[:8]}.trace"))

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class TraceSource(DataSource):
    """format("packet_trace"): option path, a file or a folder that all executors see; option records for each partition."""

    @classmethod
    def name(cls):
        return "packet_trace"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return TraceReader(self.options["path"], int(self.options.get("records", RECORDS)))

    def writer(self, schema, overwrite):
        return TraceWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def read_trace(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """The records of a trace with `us`, whole microseconds of the timestamp, and `seq`, their order."""
    register(spark)
    return spark.read.format("packet_trace").option("records", records).load(path).withColumn("us", (F.col("pkt_ts") * 1e6).cast("long"))


def write_trace(df: DataFrame, path: str) -> None:
    """Writes rows with the record's columns, one file a partition; columns that are missing are 0."""
    register(df.sparkSession)
    if "pkt_ts" not in df.columns:
        df = df.withColumn("pkt_ts", F.col("us") / 1e6)
    kinds = dict(x.split() for x in _SCHEMA.split(", ")[:-1])
    columns = [(F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c) for c, t in kinds.items()]
    df.select(*columns, F.lit(0).cast("long").alias("seq")).write.format("packet_trace").mode("overwrite").save(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Flow keys of a key file: a 64-bit count, and as many packed 13-byte keys, destination first."""
    kind = np.dtype([("dst_ip", "<u4"), ("src_ip", "<u4"), ("dst_port", "<u2"), ("src_port", "<u2"), ("proto", "u1")])

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                n = int.from_bytes(content[:8], "little")
                rows = np.frombuffer(content, kind, n, offset=8)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int64), pa.int64()) for c in kind.names], list(kind.names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{c} long" for c in kind.names))
