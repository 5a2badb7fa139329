"""Audit pack of the ledger (MRT-12): what was counted, what was left out, why.

Each table alone is one aggregation over the classified ledger; the five monthly
measures are conditional sums in a single pass (one shuffle on period) instead
of five aggregates joined together. The whole pack is one aggregation too:
``audit_cube`` has every measure by reason, by category, by account, by period
and in total from one scan (GROUPING SETS), and its tables are cut out of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions.nulls import asc_last, desc_last, flag_or, sum0
from ..functions.periods import month_label
from ..functions.text import normalize_terms
from ..operators import aggregates as A
from ..operators import classify as C
from ..rules import DEFAULT_RULES, LedgerRules

# The metrics' names and the samples' columns in their order.
METRIC_LOADED = "Linhas carregadas em fact_transacoes"
METRIC_YES = "Linhas com entra_custo_pessoal = Sim"
METRIC_NO = "Linhas com entra_custo_pessoal = Não"
METRIC_GROSS = "Soma de valor_real_dashboard antes dos filtros"
METRIC_KEPT = "Soma de valor_real_dashboard depois dos filtros de gasto pessoal"

INCLUDED_COLUMNS = ("data", "period_label", "origem", "categoria_dashboard", "categoria_original_excel",
                    "descricao", "valor_real_dashboard", "entra_custo_pessoal", "parcela_compra")
EXCLUDED_COLUMNS = ("data", "period_label", "origem", "categoria_dashboard", "categoria_original_excel",
                    "descricao", "valor_real_dashboard", "entra_custo_pessoal", S.REASON)


def _amount(df: DataFrame, rules: LedgerRules):
    a = rules.roles.amount
    return F.col(a) if a in df.columns else F.lit(None).cast("decimal(28,8)")


def audit_summary(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Five headline metrics, long format (metric, value), from one scan."""
    inc = S.norm(rules.roles.include_flag)
    text = F.coalesce(F.col(inc), F.lit("")) if inc in ledger.columns else F.lit("")
    v = _amount(ledger, rules)
    one = ledger.agg(
        F.count(F.lit(1)).cast("double").alias("loaded"),
        F.count_if(text.isin(list(normalize_terms(rules.truthy)))).cast("double").alias("yes"),
        F.count_if(text.isin(list(normalize_terms(rules.falsy)))).cast("double").alias("no"),
        sum0(v).cast("double").alias("gross"),
        sum0(F.when(flag_or(ledger, S.IS_PERSONAL), v)).cast("double").alias("kept"),
    )
    pairs = [(METRIC_LOADED, "loaded"), (METRIC_YES, "yes"), (METRIC_NO, "no"),
             (METRIC_GROSS, "gross"), (METRIC_KEPT, "kept")]
    stack = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(c).alias("value"))
                               for i, (m, c) in enumerate(pairs)]))
    return one.select(stack).orderBy("position")


def audit_counts(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Row counts of the diagnostic page: loaded, counted, excluded, excluded value."""
    v = _amount(ledger, rules)
    personal = flag_or(ledger, S.IS_PERSONAL)
    return ledger.agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(personal).alias("rows_counted"),
        F.count_if(~personal).alias("rows_excluded"),
        sum0(F.when(~personal, v)).cast("double").alias("excluded_value"))


def audit_exclusions(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Excluded rows by reason ('' -> 'outros'): count and sum, largest sum first."""
    excluded = C.excluded_rows(ledger)
    reason = F.coalesce(F.nullif(F.col(S.REASON), F.lit("")), F.lit(R.REASON_OTHER)) \
        if S.REASON in excluded.columns else F.lit(R.REASON_OTHER)
    out = A.group_count_sum(excluded.withColumn("__reason", reason), "__reason", rules.roles.amount,
                            key_name=S.REASON)
    return out.select(S.REASON, "row_count", F.col("total").cast("double").alias("total"))


def audit_months(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Gross, personal, excluded, staked and returned per month, in one pass (JON-1)."""
    personal = flag_or(ledger, S.IS_PERSONAL)
    non_total = ~flag_or(ledger, S.IS_TOTAL)
    measures = {
        "gross": F.lit(True),
        "personal": personal,
        "excluded": ~personal,
        "staked": flag_or(ledger, S.IS_STAKE) & non_total,
        "returned": flag_or(ledger, S.IS_PAYOUT) & non_total,
    }
    out = A.conditional_monthly(ledger, rules.roles.amount, measures)
    return out.select(S.PERIOD, S.PERIOD_LABEL, *[F.col(m).cast("double").alias(m) for m in measures]).orderBy(S.PERIOD)


def audit_categories(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Personal cost by category: rows, sum and share of the personal total (WIN-5)."""
    personal = C.personal_costs(ledger)
    out = A.group_count_sum(personal, rules.roles.category, rules.roles.amount, key_name="category")
    out = A.share_of_total(out, "total", "share_pct")
    return out.select("category", "row_count", F.col("total").cast("double").alias("total"), "share_pct")


def audit_sources(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Personal cost by account: rows and sum."""
    personal = C.personal_costs(ledger)
    out = A.group_count_sum(personal, rules.roles.account, rules.roles.amount, key_name="source")
    return out.select("source", "row_count", F.col("total").cast("double").alias("total"))


def audit_samples(ledger: DataFrame, order_cols=(S.PERIOD,), n: int = 100) -> dict[str, DataFrame]:
    """First n counted and first n excluded rows, in a stable order (SRT-4)."""
    return {
        "included": A.sample(C.personal_costs(ledger), INCLUDED_COLUMNS, order_cols, n),
        "excluded": A.sample(C.excluded_rows(ledger), EXCLUDED_COLUMNS, order_cols, n),
    }


CUBE_KEYS = (S.REASON, "category", "source", S.PERIOD)
SECTIONS = ("exclusions", "categories", "sources", "months")
MEASURES = ("row_count", "rows_counted", "yes", "no", "gross", "kept", "staked", "returned")


def audit_cube(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """(section, key, measures): every measure of the pack by exclusion reason of the rows left out, by category
    and by account of the rows counted, by period of all rows, and for the whole ledger (section ``summary``)."""
    r = rules.roles
    inc = S.norm(r.include_flag)
    text = F.coalesce(F.col(inc), F.lit("")) if inc in ledger.columns else F.lit("")
    personal, none = flag_or(ledger, S.IS_PERSONAL), F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in ledger.columns else none
    non_total = ~flag_or(ledger, S.IS_TOTAL)
    rows = ledger.select(
        F.when(~personal, F.coalesce(F.nullif(column(S.REASON), F.lit("")), F.lit(R.REASON_OTHER))).alias(S.REASON),
        F.when(personal, column(r.category)).alias("category"), F.when(personal, column(r.account)).alias("source"), column(S.PERIOD).alias(S.PERIOD),
        _amount(ledger, rules).alias("v"), personal.alias("personal"), text.alias("answer"),
        (flag_or(ledger, S.IS_STAKE) & non_total).alias("stake"), (flag_or(ledger, S.IS_PAYOUT) & non_total).alias("payout"))
    v = F.col("v")
    cube = rows.groupingSets([[k] for k in CUBE_KEYS] + [[]], *CUBE_KEYS).agg(
        F.grouping_id().alias("sets"), F.count(F.lit(1)).alias("row_count"), F.count_if("personal").alias("rows_counted"),
        F.count_if(F.col("answer").isin(list(normalize_terms(rules.truthy)))).alias("yes"),
        F.count_if(F.col("answer").isin(list(normalize_terms(rules.falsy)))).alias("no"),
        sum0(v).alias("gross"), sum0(F.when(F.col("personal"), v)).alias("kept"),
        sum0(F.when(F.col("stake"), v)).alias("staked"), sum0(F.when(F.col("payout"), v)).alias("returned"))
    every = (1 << len(CUBE_KEYS)) - 1
    section, key = F.lit("summary"), none
    for i, (name, column_name) in enumerate(zip(SECTIONS, CUBE_KEYS)):
        here = F.col("sets") == every - (1 << len(CUBE_KEYS) - 1 - i)
        section, key = F.when(here, F.lit(name)).otherwise(section), F.when(here, F.col(column_name)).otherwise(key)
    # rows without a key aren't a group of their section
    return cube.select(section.alias("section"), key.alias("key"), *MEASURES).where("section = 'summary' OR key IS NOT NULL")


def audit_tables(cube: DataFrame) -> dict[str, DataFrame]:
    """The pack's aggregated tables, cut out of a cube (``audit_cube``)."""
    part = lambda name: cube.where(F.col("section") == name)
    d = lambda c: F.col(c).cast("double")
    pairs = [(METRIC_LOADED, "row_count"), (METRIC_YES, "yes"), (METRIC_NO, "no"), (METRIC_GROSS, "gross"), (METRIC_KEPT, "kept")]
    stack = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), d(c).alias("value")) for i, (m, c) in enumerate(pairs)]))
    counted = lambda name, column: (part(name).select(F.col("key").alias(column), "row_count", "kept")
                                    .orderBy(desc_last("kept"), asc_last(column)))
    categories = A.share_of_total(counted("categories", "category"), "kept", "share_pct")
    return {
        "summary": part("summary").select(stack).orderBy("position"),
        "exclusions": part("exclusions").orderBy(desc_last("gross"), asc_last("key")).select(F.col("key").alias(S.REASON), "row_count", d("gross").alias("total")),
        "months": part("months").select(F.col("key").alias(S.PERIOD), month_label(F.col("key")).alias(S.PERIOD_LABEL), d("gross").alias("gross"), d("kept").alias("personal"),
                                        (F.col("gross") - F.col("kept")).cast("double").alias("excluded"), d("staked").alias("staked"),
                                        d("returned").alias("returned")).orderBy(S.PERIOD),
        "categories": categories.select("category", "row_count", d("kept").alias("total"), "share_pct"),
        "sources": counted("sources", "source").select("source", "row_count", d("kept").alias("total")),
    }


def audit_pack(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES, order_cols=(S.PERIOD,), cube: DataFrame | None = None) -> dict[str, DataFrame]:
    """All audit tables. Pass a materialized ledger, and ``cube=ingest.materialize(audit_cube(ledger), name)``
    to have the five aggregated tables from one scan of it; the row samples read the ledger."""
    return audit_tables(audit_cube(ledger, rules) if cube is None else cube) | audit_samples(ledger, order_cols)
