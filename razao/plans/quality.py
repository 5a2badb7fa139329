"""Data-quality report over a loaded workbook (DQ-1..8).

Schema checks (a missing table, missing expected columns) are decided on the
driver from the schema. Row checks (total lines, rows without a month,
invalid amounts, blank categories) are counted while a table is written
(``ingest.ingest_table(checks=...)``); a table that wasn't written so is
aggregated once. The result is a small DataFrame of issues in table order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions.nulls import flag_or
from ..functions.text import strip
from ..rules import DEFAULT_RULES, LEDGER_TABLE, LedgerRules

ISSUE_SCHEMA = "table_order int, check_order int, table_name string, level string, message string"


def _literal_issues(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


#: Check name, its place, and its message after the count (or alone).
CHECKS = (("total_lines", 1, R.ISSUE_TOTAL_LINES, True), ("no_month", 2, R.ISSUE_NO_MONTH, True),
          ("no_amount", 3, R.ISSUE_NO_AMOUNT, True), ("blank_category", 4, R.ISSUE_NO_CATEGORY, False))


def row_checks(df: DataFrame, table: str, rules: LedgerRules = DEFAULT_RULES) -> dict[str, Column]:
    """DQ-3..7: the counts of one table as aggregate expressions. ``ingest.ingest_table(checks=...)``
    gathers them while it writes the table, so that the report reads no row again."""
    r = rules.roles
    aggs = {"rows": F.count(F.lit(1))}
    if S.IS_TOTAL in df.columns:
        aggs["total_lines"] = F.count_if(flag_or(df, S.IS_TOTAL))
    if S.PERIOD in df.columns:
        aggs["no_month"] = F.count_if(F.col(S.PERIOD).isNull())
    if table == LEDGER_TABLE and r.amount in df.columns:
        aggs["no_amount"] = F.count_if(F.col(r.amount).isNull())
    if table == LEDGER_TABLE and r.category in df.columns:
        aggs["blank_category"] = F.count_if(F.coalesce(strip(F.col(r.category)), F.lit("")) == "")
    return aggs


def _row_issues(df: DataFrame, table: str, order: int, rules: LedgerRules) -> DataFrame | None:
    """DQ-3..6 for one table whose counts aren't known: one aggregate, then at most four issue rows."""
    aggs = row_checks(df, table, rules)
    if len(aggs) == 1:
        return None
    one = df.agg(*[e.alias(n) for n, e in aggs.items()])
    rows = F.array(*[F.when(F.col(n) > 0, F.struct(F.lit(i).alias("check_order"), (F.concat(F.col(n).cast("string"), F.lit(text)) if counted
                                                                                   else F.lit(text)).alias("message")))
                     for n, i, text, counted in CHECKS if n in aggs])
    return (one.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("i"))
            .select(F.lit(order).alias("table_order"), F.col("i.check_order").alias("check_order"),
                    F.lit(table).alias("table_name"), F.lit(R.LEVEL_WARNING).alias("level"),
                    F.col("i.message").alias("message")))


def _known_issues(counts: dict[str, int], table: str, order: int) -> list[tuple]:
    """The same from known counts."""
    return [(order, i, table, R.LEVEL_WARNING, f"{counts[n]}{text}" if counted else text) for n, i, text, counted in CHECKS if counts.get(n, 0) > 0]


def quality_issues(spark: SparkSession, tables: dict[str, DataFrame], names=R.TABLE_NAMES,
                   rules: LedgerRules = DEFAULT_RULES, checks: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """DQ-1..6 + DQ-8: every issue as (table, level, message), in table order. Tables whose counts are
    in ``checks`` aren't read."""
    expected = dict(R.EXPECTED_COLUMNS)
    literal = []
    parts = []
    for order, name in enumerate(names):
        if name not in tables:
            literal.append((order, 0, name, R.LEVEL_ERROR, R.ISSUE_NOT_LOADED))
            continue
        df = tables[name]
        missing = [c for c in expected.get(name, ()) if c not in df.columns]
        if missing:
            literal.append((order, 0, name, R.LEVEL_WARNING, R.ISSUE_MISSING_COLUMNS + ", ".join(missing)))
        if name in (checks or {}):
            literal += _known_issues(checks[name], name, order)
            continue
        part = _row_issues(df, name, order, rules)
        if part is not None:
            parts.append(part)
    out = _literal_issues(spark, literal)
    for p in parts:
        out = out.unionByName(p)
    return out.orderBy("table_order", "check_order").select("table_name", "level", "message")


def quality_status(issues: DataFrame) -> DataFrame:
    """DQ-8: overall status, OK when there is no issue."""
    return issues.agg(F.count(F.lit(1)).alias("issues")).select(
        F.when(F.col("issues") == 0, F.lit("OK")).otherwise(F.lit("Atenção")).alias("status"), "issues")


def table_inventory(spark: SparkSession, tables: dict[str, DataFrame], names=R.TABLE_NAMES,
                    checks: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """DQ-7: rows and column list per table (one count per table, unioned; none where ``checks`` has it)."""
    out = None
    for order, name in enumerate(names):
        if name not in tables or name in (checks or {}):
            known = (checks[name]["rows"], ", ".join(tables[name].columns)) if name in tables else (0, "")
            part = spark.createDataFrame([(order, name, *known)], "table_order int, table_name string, row_count long, columns string")
        else:
            df = tables[name]
            part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(order).alias("table_order"), F.lit(name).alias("table_name"), "row_count",
                F.lit(", ".join(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("table_order").drop("table_order")
