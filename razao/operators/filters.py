"""Row filters and facet helpers (FLT-2..4, FLT-12..17, JON-5, JON-6).

Small value lists stay ``isin`` (an in-set test inside codegen); a list held
in a DataFrame becomes a semi/anti join, which Spark broadcasts only when
the runtime statistics show it is small (AQE), else sort-merges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.nulls import flag, not_in
from ..functions.text import contains_any, normalize, normalize_py, normalize_terms
from ..rules import DEFAULT_RULES, LedgerRules
from .terms import add_contains_flag


def period_filter(df: DataFrame, periods=None, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-2: keep the given periods; an empty selection keeps everything.

    On a table written by ``write_clean`` (partitioned by period) the test is
    partition pruning; on a materialized one Parquet skips row groups by it.
    Where a row's period came from its date (``period_from``), the date must lie
    between the first and the last period too, so files sorted by date are
    skipped likewise; rows whose period came from elsewhere are kept or not by
    their period alone, whatever their date.
    """
    periods = sorted(p for p in (periods or []) if p)
    if not periods or S.PERIOD not in df.columns:
        return df
    kept = df.where(F.col(S.PERIOD).isin(periods))
    date = rules.roles.date
    whole = all(re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", p) for p in periods)
    if not whole or S.PERIOD_FROM not in df.columns or dict(df.dtypes).get(date) != "date":
        return kept
    year, month = map(int, periods[-1].split("-"))
    first, after = f"{periods[0]}-01", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"
    inside = (F.col(date) >= F.lit(first).cast("date")) & (F.col(date) < F.lit(after).cast("date"))
    return kept.where(F.col(S.PERIOD_FROM).isNull() | (F.col(S.PERIOD_FROM) != S.FROM_DATE) | inside)


def facet_filter(df: DataFrame, periods=None, accounts=None, categories=None,
                 rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-3: period, account and category selections, each optional."""
    r = rules.roles
    out = period_filter(df, periods)
    if accounts and r.account in out.columns:
        out = semi_join_values(out, r.account, accounts)
    if categories and r.category in out.columns:
        out = semi_join_values(out, r.category, categories)
    return out


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """FLT-4: distinct non-null, non-empty values, sorted."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{column}` string")
    c = F.col(column).cast("string")
    return (df.select(c.alias(column)).where(c.isNotNull() & (c != ""))
            .distinct().orderBy(F.col(column)))


def semi_join_values(df: DataFrame, column: str, values) -> DataFrame:
    """JON-5: keep rows whose value is in a list or in a one-column DataFrame."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).cast("string").alias("__key")).distinct()
        return df.join(keys, F.col(column).cast("string") == F.col("__key"), "left_semi")
    return df.where(F.col(column).cast("string").isin([str(v) for v in values]))


def anti_join_values(df: DataFrame, column: str, values) -> DataFrame:
    """JON-6: drop rows whose value is in a list or DataFrame; NULL values stay."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).cast("string").alias("__key")).where(
            F.col("__key").isNotNull()).distinct()
        return df.join(keys, F.col(column).cast("string") == F.col("__key"), "left_anti")
    return df.where(not_in(F.col(column).cast("string"), [str(v) for v in values]))


def description_search(df: DataFrame, term: str, mode: str = "literal",
                       rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-12: search the normalized description; the term is normalized too (D10).

    ``mode='literal'`` is a substring test, ``mode='regex'`` a regex.
    """
    if not term:
        return df
    col = S.norm(rules.roles.description)
    text = F.col(col) if col in df.columns else normalize(rules.roles.description)
    t = normalize_py(term)
    cond = text.rlike(t) if mode == "regex" else text.contains(t)
    return df.where(flag(cond))


def exclude_technical(df: DataFrame, rules: LedgerRules = DEFAULT_RULES, show_technical: bool = False) -> DataFrame:
    """FLT-13: drop technical categories, unless that leaves nothing, then keep all.

    The fallback is one uncorrelated EXISTS subquery (a single-row job), not a
    count on the driver.
    """
    cat = rules.roles.category
    if show_technical or cat not in df.columns:
        return df
    technical = flag(F.col(cat).isin(list(rules.technical_categories)))
    kept = df.where(~technical)
    return df.where(~technical | ~kept.exists())


def receivable_items(df: DataFrame, item_col: str, rules: LedgerRules = DEFAULT_RULES, terms: DataFrame | None = None) -> DataFrame:
    """FLT-14: items holding any receivable term, or a rebate; adds ``is_rebate`` and
    ``item_text_norm`` (the standardized ``<item>_norm`` twin is reused when present).
    ``terms``, a table with a column ``term`` of normalized terms, takes the place of the rules' list."""
    twin = S.norm(item_col)
    text = F.coalesce(F.col(twin), F.lit("")) if twin in df.columns else normalize(item_col)
    df = df.withColumn("__item_n", text)
    if terms is not None:
        df = add_contains_flag(df, "__item_n", terms, "__house", rules.whole_word)
        house = F.col("__house")
    else:
        house = contains_any(F.col("__item_n"), normalize_terms(rules.receivable_terms), whole_word=rules.whole_word)
    rebate = F.col("__item_n").rlike(rules.rebate_pattern)
    return (df.withColumn("is_rebate", flag(rebate))
              .where(flag(house) | F.col("is_rebate")).drop("__house").withColumnRenamed("__item_n", "item_text_norm"))


def utility_class(item: Column, rules: LedgerRules = DEFAULT_RULES, normalized: bool = False) -> Column:
    """FLT-15: utility class by keyword, the last matching class winning; NULL if none.

    Pass an already normalized column with ``normalized=True`` so the text is
    normalized once, not once per class.
    """
    text = item if normalized else normalize(item)
    # Last match wins: test in reverse order and take the first hit.
    chain = None
    for label, pattern in reversed(rules.utility_classes):
        cond = flag(text.rlike(pattern))
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
    return chain


def raw_category_is(df: DataFrame, value: str, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """FLT-16: rows whose normalized raw category equals a value."""
    col = S.norm(rules.roles.raw_category)
    text = F.col(col) if col in df.columns else normalize(rules.roles.raw_category)
    return df.where(flag(text == normalize_py(value)))
