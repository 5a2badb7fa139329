"""A CSV table in several parts, each with a header of its own (SRC-1).

A folder of exports read with one header takes cells by position: a part with
another column order is misread and a row with too many cells loses its tail.
Here each part is read by its own header line and the parts are united by the
standard form of their names. A row whose number of cells isn't its header's is
kept apart, whole, with the part it came from.

The driver reads the header of each part and nothing else: of a few parts by a
one-row Spark job each, several at a time; of many by one scan, which gathers the
first record of every file, and one such job for each different first record.
Parts with the same header are one scan, so the plan grows with the number of
different headers, not of files.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

#: The raw text of a row with a wrong number of cells; no standard name begins with '_'.
RAGGED = "_ragged_record"
QUARANTINE = "part string, expected_cells int, record string"
HEADERS_AT_ONCE = 16
#: Parts up to which each one's header is read by a job of its own, which leaves the rest of the part unread.
HEADER_JOBS = 64


def csv_options(multi_line: bool = False) -> dict:
    """How every CSV export is read, in batch and as a stream: text cells, a quote in a quoted cell doubled.
    ``multi_line`` lets quoted cells hold line breaks."""
    return {"header": True, "inferSchema": False, "encoding": "UTF-8", "escape": '"', "multiLine": multi_line}


def text_schema(names) -> T.StructType:
    """All-text schema for these column names (never inferred)."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


@dataclass(frozen=True)
class Parts:
    """``rows``: the cells of all sound rows by standard column name, absent columns NULL.
    ``quarantine``: (part, expected_cells, record) of every row with another number of cells than its header."""

    rows: DataFrame
    quarantine: DataFrame


def _header(spark: SparkSession, part: str, multi_line: bool) -> tuple[str, ...] | None:
    first = spark.read.options(**csv_options(multi_line) | {"header": False}).csv(part).head(1)
    return tuple(S.standard_names(["" if c is None else c for c in first[0]])) if first else None


def _by_first_record(spark: SparkSession, parts: list[str], multi_line: bool) -> list[list[str]]:
    """The parts that begin with the same record, together, in one scan; a part without a record is in none."""
    # one column alone: a record of more cells is kept whole beside its first cell
    df = (spark.read.options(**csv_options(multi_line) | {"header": False}).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAGGED)
          .option("columnPruning", False).schema(text_schema(["cell", RAGGED])).csv(parts))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    first = (df.select(F.input_file_name().alias("part"), F.struct("cell", RAGGED).alias("record"), at.alias("at"))
             .groupBy("part").agg(F.min_by("record", "at").alias("record")))
    return [r["parts"] for r in first.groupBy("record").agg(F.collect_list("part").alias("parts")).collect()]


def _headers(spark: SparkSession, parts: list[str], multi_line: bool) -> list[tuple[str, ...] | None]:
    """Each part's column names; None where it is empty."""
    groups = [[p] for p in parts] if len(parts) <= HEADER_JOBS else _by_first_record(spark, parts, multi_line)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        named = list(pool.map(lambda group: _header(spark, group[0], multi_line), groups))
    known = {p: names for group, names in zip(groups, named) for p in group}
    return [known.get(p) for p in parts]


def read_parts(spark: SparkSession, path: str, multi_line: bool = False, part_column: str | None = None) -> Parts:
    """All parts under ``path`` (a file, a folder or a pattern). Empty files are skipped.

    ``part_column`` adds a column of that name with the file each row came from."""
    files = sorted(spark.read.text(path).inputFiles())
    scans: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, _headers(spark, files, multi_line)):
        if names is not None:
            scans.setdefault(names, []).append(file)
    rows, ragged = None, spark.createDataFrame([], QUARANTINE)
    for names, group in scans.items():
        # without column pruning, so that a row's cells are counted whatever columns a query reads
        df = (spark.read.options(**csv_options(multi_line)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAGGED)
              .option("columnPruning", False).schema(text_schema([*names, RAGGED])).csv(group))
        part = F.col("_metadata.file_path")
        # a query that reads the raw text alone isn't allowed, so this reads nothing of the first cell beside it
        record = F.concat_ws("", F.col(RAGGED), F.substring(F.col(names[0]), 1, 0))
        sound = df.where(record == "").select(*names, *([part.alias(part_column)] if part_column else []))
        rows = sound if rows is None else rows.unionByName(sound, allowMissingColumns=True)
        ragged = ragged.unionByName(df.where(record != "").select(
            part.alias("part"), F.lit(len(names)).alias("expected_cells"), record.alias("record")))
    return Parts(spark.createDataFrame([], T.StructType([])) if rows is None else rows, ragged)
