"""Column helpers that give pandas-style null handling on Spark (CND-1).

Spark and pandas disagree on a few null rules; every operator goes through
these helpers instead of spelling the rule out again:

* a missing column is a literal default, decided from the schema only;
* ``sum`` over nothing is 0, not NULL;
* flags are never NULL;
* NULL sorts last in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(df: DataFrame, *names: str) -> bool:
    cols = set(df.columns)
    return all(n in cols for n in names)


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """``F.col(name)`` when the column exists, else a literal default."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def flag(c: Column) -> Column:
    """A boolean that is never NULL."""
    return F.coalesce(c, F.lit(False))


def flag_or(df: DataFrame, name: str) -> Column:
    return flag(F.col(name)) if name in df.columns else F.lit(False)


def sum0(c: Column) -> Column:
    """``sum`` with pandas semantics: nothing or all-NULL sums to 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def asc_last(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c.asc_nulls_last()


def desc_last(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c.desc_nulls_last()


def not_in(c: Column, values) -> Column:
    """``~isin`` that is True on NULL, as pandas' ``~Series.isin``."""
    return ~flag(c.isin(list(values)))


def first_present(df: DataFrame, candidates) -> str | None:
    """The first candidate name present in the schema (driver-side, no job)."""
    for name in candidates:
        if name and name in df.columns:
            return name
    return None
