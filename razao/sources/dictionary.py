"""Parse each distinct text once (SRC-5, PRJ-1, PRJ-2 on columns with few values).

Month, date, category and account cells repeat: a ledger has a few thousand
different ones in any number of rows. For such a column the distinct texts are
gathered once, parsed there, and every row looks its cell up in a broadcast
table. Nothing is assumed about a column: one pass estimates its distinct texts,
and a column with few repeats, or whose texts together exceed ``MAX_BYTES``, is
parsed row by row as before. The result is the same either way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import month_label, with_date, with_month
from ..functions.text import normalize
from ..session import ensure_checkpoint_dir

#: Rows for each distinct text, on average, below which a column isn't looked up.
LEAST_REPEATS = 4
#: Bytes of all distinct texts of a column up to which they are broadcast.
MAX_BYTES = 16 << 20


def parsed(column: str, kind: str) -> str:
    """Where a row's looked-up result of a kind (``date``, ``period`` with its ``label``, or ``norm``) is held."""
    return f"__{column}_{kind}"


def estimates(wanted) -> dict[str, Column]:
    """The rows and each column's distinct texts, about, as aggregates."""
    return {"rows": F.count(F.lit(1))} | {f"c{i}": F.approx_count_distinct(c) for i, c in enumerate(wanted)}


def learn(df: DataFrame, wanted: dict[str, tuple[str, ...]], default_year: int, about: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Lookup tables (text, and the kinds ``wanted`` of the column) for those columns that repay one.

    Two passes over the columns named: one estimates (none where ``about`` has the ``estimates``), one gathers the
    distinct texts of the columns chosen, pre-aggregated in every task, into a table in the shared checkpoint folder."""
    if not wanted:
        return {}
    if about is None:
        about = df.agg(*[e.alias(n) for n, e in estimates(wanted).items()]).first()
    chosen = [c for i, c in enumerate(wanted) if about[f"c{i}"] * LEAST_REPEATS <= about["rows"]]
    if not chosen:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("text")) for i, c in enumerate(chosen)])
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/razao-texts/{uuid.uuid4().hex}"
    (df.select(F.explode(cells).alias("cell")).select("cell.*").where("text IS NOT NULL").distinct()
     .write.partitionBy("column").parquet(path))
    texts = df.sparkSession.read.schema("text string, column int").parquet(path)
    size = {r["column"]: r["bytes"] for r in texts.groupBy("column").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    return {c: _parsed_texts(texts.where(F.col("column") == i).select("text"), wanted[c], default_year)
            for i, c in enumerate(chosen) if size.get(i, 0) <= MAX_BYTES}


def _parsed_texts(texts: DataFrame, kinds: tuple[str, ...], default_year: int) -> DataFrame:
    if "date" in kinds:
        texts = with_date(texts, "text", "date")
    if "period" in kinds:
        texts = with_month(texts, "text", "period", default_year).withColumn("label", month_label(F.col("period")))
    if "norm" in kinds:
        texts = texts.withColumn("norm", normalize("text"))
    return texts


def attach(df: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Every row with its cells' results in ``parsed`` columns; the tables' size was checked when they were learned."""
    for c, table in lookups.items():
        key = parsed(c, "text")
        named = table.select(F.col("text").alias(key), *[F.col(k).alias(parsed(c, k)) for k in table.columns if k != "text"])
        df = df.join(F.broadcast(named), F.col(f"`{c}`") == F.col(key), "left").drop(key)
        if "norm" in table.columns:  # a NULL cell is in no table
            df = df.withColumn(parsed(c, "norm"), F.coalesce(parsed(c, "norm"), F.lit("")))
    return df
