"""Shared helpers of the text operators: table readers, intermediate tables in
the shared checkpoint folder, and bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one Python step holds at a time, beside a single longer text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it
    back: the lineage is cut, and a lost executor costs a re-read of files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/razao-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def lowest(df: DataFrame, by: Column, n: int, total: int) -> DataFrame:
    """The rows of ``df`` with the ``n`` smallest hashes ``by`` (longs spread evenly), for a bounded sample.

    Of ``total`` rows only those in the lowest part of the hash range that should hold 2n are sorted, so what tasks send
    to be merged is about 2n rows together, however many tasks there are."""
    part = min(1.0, 2 * n / max(total, 1))
    near = df if part >= 1 else df.where(by <= F.lit(int(part * 2 ** 64) - 2 ** 63))
    return near.orderBy(by).limit(n)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        rows = max(1, int(len(batch) * limit / max(1, col.nbytes)))
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
