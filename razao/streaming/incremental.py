"""Incremental ingestion: the standardize job on a folder of exports, as a stream.

The source has no streaming operator; its only notion of freshness is a
600-second reload of the workbook. The equivalent here is a Structured
Streaming query that picks up new export files from a folder, runs the same
per-row standardize job (it is stateless and narrow, so it streams as is)
and appends clean Parquet partitioned by period. Progress lives in a
checkpoint folder that the caller names and keeps for the life of the stream
(never in one that belongs to a session), so a restarted query resumes where it
stopped, and a lost executor only re-runs its tasks.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..rules import DEFAULT_RULES, LedgerRules
from ..sources.ingest import NOT_FOUND, by_period, standardize
from ..sources.parts import csv_options, text_schema

RELOAD_SECONDS = 600
#: In the output folder: the id of the stream that writes there. Readers skip names that begin with '_'.
OWNER = "_stream"


def read_exports(spark: SparkSession, folder: str, headers, table: str, rules: LedgerRules = DEFAULT_RULES,
                 max_files_per_trigger: int | None = None, multi_line: bool = False) -> DataFrame:
    """A streaming DataFrame of standardized rows from CSV exports landing in ``folder``, read as in batch.

    All exports have the same ``headers``, in this order."""
    reader = spark.readStream.options(**csv_options(multi_line)).schema(text_schema(headers))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return standardize(reader.csv(folder), table, rules)


def write_clean_stream(df: DataFrame, path: str, checkpoint: str, reload_seconds: int | None = RELOAD_SECONDS,
                       available_now: bool = False) -> StreamingQuery:
    """Append the stream to Parquet by period folders under ``path``.

    ``checkpoint`` is the stream's own folder in shared storage; give the same
    one, and the same ``path``, whenever the stream is started again. A path that
    holds another stream's output, or this one's from before its checkpoint was
    lost, is refused: its batches would be replaced by others of the same number.
    Each micro-batch is gathered by period before the write, so it adds a few
    files a period and not one for each task and period.
    """
    spark = df.sparkSession
    owner, own = _line(spark, f"{path}/{OWNER}"), _stream_id(spark, checkpoint)
    if owner is not None and owner != own:
        raise ValueError(f"{path!r} holds the output of another stream or of a lost checkpoint, not of {checkpoint!r}")
    if owner is None and own is None and _holds_rows(spark, path):
        raise ValueError(f"{path!r} holds data that no stream has written")

    def append(batch: DataFrame, number: int) -> None:
        if _line(spark, f"{path}/{OWNER}") is None:
            spark.createDataFrame([(_stream_id(spark, checkpoint),)], "value string").write.mode("ignore").text(f"{path}/{OWNER}")
        # a batch that runs again after a failure replaces its own files
        by_period(batch).write.mode("overwrite").partitionBy(S.PERIOD).parquet(f"{path}/batch={number}")

    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(append)
    if available_now:
        w = w.trigger(availableNow=True)
    elif reload_seconds:
        w = w.trigger(processingTime=f"{reload_seconds} seconds")
    return w.start()


def _line(spark: SparkSession, path: str) -> str | None:
    """The first line of a small text file or folder; None if there is none."""
    try:
        first = spark.read.text(path).head(1)
    except AnalysisException as exc:
        if exc.getCondition() not in NOT_FOUND:
            raise
        return None
    return first[0][0] if first else None


def _stream_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that Spark keeps in a stream's checkpoint, the same over all restarts; None before the first start."""
    line = _line(spark, f"{checkpoint}/metadata")
    return json.loads(line)["id"] if line else None


def _holds_rows(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).head(1))
    except AnalysisException as exc:
        if exc.getCondition() in (*NOT_FOUND, "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
