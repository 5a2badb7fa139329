"""Result tables built from the cleaned ledger tables (MRT-1..11).

Each mart is a lazy DataFrame plan: scans of the standardized tables,
per-row filters, partial aggregation, one shuffle on a business key, and
small joins between aggregated frames. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions.nulls import asc_last, desc_last, flag_or, sum0
from ..functions.numbers import format_money, format_pct, guarded_pct, money_or_dash
from ..functions.periods import format_date, month_label
from ..functions.text import normalize, truncate
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import filters as FL
from ..rules import DEFAULT_RULES, LedgerRules


def _dbl(c: Column) -> Column:
    return c.cast("double")


# ------------------------------------------------------------------ revenue

def monthly_revenue(dim_months: DataFrame, periods=None) -> DataFrame:
    """Revenue per period from the month dimension (SRC-11 column), aggregated
    by period first so a repeated month cannot fan out a join (D9)."""
    col = S.revenue_column(dim_months)
    if col is None or S.PERIOD not in dim_months.columns:
        return dim_months.sparkSession.createDataFrame([], f"{S.PERIOD} string, revenue decimal(38,8)")
    src = FL.period_filter(dim_months, periods)
    return src.where(F.col(S.PERIOD).isNotNull()).groupBy(S.PERIOD).agg(sum0(F.col(col)).alias("revenue"))


# ------------------------------------------------------------------ MRT-1

def cash_per_period(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """Cash out per period (the NULL period kept, for the year total): a row per month, which the
    series, the change window and the year total all read. Lazy; a caller that needs several of
    them computes it once and passes it to each as ``per_period``."""
    return C.cash_costs(ledger, rules).groupBy(S.PERIOD).agg(sum0(F.col(rules.roles.amount)).alias("cash_out"))


def _cash_flow_series(per_period: DataFrame, dim_months: DataFrame) -> DataFrame:
    """Exact (decimal) revenue, cash out and balance of every month with cash rows, change in double."""
    monthly = per_period.where(F.col(S.PERIOD).isNotNull())
    out = (monthly.join(monthly_revenue(dim_months), S.PERIOD, "left")
           .withColumn("revenue", F.coalesce(F.col("revenue"), F.lit(0)))
           .withColumn("balance", F.col("revenue") - F.col("cash_out")))
    return A.with_change(out, "cash_out").drop("change_pct", "direction")


def cash_flow_monthly(ledger: DataFrame | None, dim_months: DataFrame, periods=None,
                      rules: LedgerRules = DEFAULT_RULES, per_period: DataFrame | None = None) -> DataFrame:
    """MRT-1 series: per period revenue, cash out, balance, % of revenue consumed
    and the change of cash out vs the previous month.

    The change is computed over all months before the selection is applied,
    so a single selected month still shows it (D17).
    """
    per_period = cash_per_period(ledger, rules) if per_period is None else per_period
    out = FL.period_filter(_cash_flow_series(per_period, dim_months), periods)
    return out.select(
        S.PERIOD, month_label(F.col(S.PERIOD)).alias(S.PERIOD_LABEL),
        _dbl(F.col("revenue")).alias("revenue"), _dbl(F.col("cash_out")).alias("cash_out"),
        _dbl(F.col("balance")).alias("balance"),
        guarded_pct(F.col("cash_out"), F.col("revenue")).alias("consumed_pct"),
        _dbl(F.col("change")).alias("change_vs_previous"),
    ).orderBy(S.PERIOD)


def cash_flow_summary(ledger: DataFrame | None, dim_months: DataFrame, periods=None,
                      rules: LedgerRules = DEFAULT_RULES, per_period: DataFrame | None = None) -> DataFrame:
    """MRT-1 metrics of a selection: revenue (AGG-13), cash out, balance, % consumed, monthly mean
    (AGG-10), latest month (WIN-7), year total, and for one month its change vs the month before.

    Revenue comes from the selected months of the revenue table, whether they have cash rows or
    not. Without a selection the last month with cash rows is the selection.
    """
    periods = [p for p in (periods or []) if p]
    per_period = cash_per_period(ledger, rules) if per_period is None else per_period
    monthly = per_period.where(F.col(S.PERIOD).isNotNull())
    if periods:
        chosen = F.col(S.PERIOD).isin(periods)
    else:
        chosen = F.col(S.PERIOD) == monthly.select(F.max(S.PERIOD)).scalar()
    one = len(set(periods)) < 2
    year_total = per_period.select(_dbl(sum0(F.col("cash_out")))).scalar()
    revenue = monthly_revenue(dim_months).where(chosen).select(sum0(F.col("revenue"))).scalar()
    agg = A.with_change(monthly, "cash_out").where(chosen).agg(
        sum0(F.col("cash_out")).alias("cash"), A.mean(F.col("cash_out")).alias("mean_monthly_cash_out"),
        F.max_by("cash_out", S.PERIOD).alias("latest"), F.count(F.lit(1)).alias("months"),
        (F.max("change") if one else F.lit(None).cast("double")).alias("change_vs_previous"))
    return agg.withColumn("rev", revenue).select(
        _dbl(F.col("rev")).alias("revenue"), _dbl(F.col("cash")).alias("cash_out"),
        "mean_monthly_cash_out", _dbl(F.col("latest")).alias("latest_cash_out"), "months",
        year_total.alias("year_total"),
        _dbl(F.col("rev") - F.col("cash")).alias("balance"),
        guarded_pct(F.col("cash"), F.col("rev")).alias("consumed_pct"), "change_vs_previous")


# ------------------------------------------------------------------ MRT-2

def cash_by_category(ledger: DataFrame, periods=None, k: int = 5,
                     rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-2: cash out by category, top k plus 'Outros', with the note and
    display name of the cash view (PRJ-10)."""
    cat, amount = rules.roles.category, rules.roles.amount
    cash = C.cash_costs(FL.period_filter(ledger, periods), rules)
    by_cat = A.sum_by(cash, cat, amount, "value")
    top = A.top_k_with_others(by_cat, k, cat, "value")
    return top.select(
        F.col(cat).alias("category"), _dbl(F.col("value")).alias("value"),
        format_money(F.col("value")).alias("value_text"),
        C.category_note(F.col(cat), "cash").alias("note"),
        C.category_display(F.col(cat)).alias("display"))


def cash_by_source(ledger: DataFrame, periods=None, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-2: cash out by relabelled account (PRJ-7), largest first."""
    amount = rules.roles.amount
    cash = C.cash_costs(FL.period_filter(ledger, periods), rules)
    return (cash.groupBy(C.cash_source(cash, rules).alias("source"))
            .agg(sum0(F.col(amount)).alias("value"))
            .select("source", _dbl(F.col("value")).alias("value"))
            .orderBy(desc_last("value"), asc_last("source")))


# ------------------------------------------------------------------ MRT-3

# The columns of the listing in their order, and the names they are shown under.
LISTING_COLUMNS = ("period_label", "data", "descricao", "origem", "categoria_dashboard",
                   "categoria_original_excel", "valor_real_dashboard", "valor_euro_dashboard", "parcela_compra")
AUDIT_EXTRA = ("entra_custo_pessoal", S.IS_SETTLEMENT, S.REASON)
PRESENTATION_NAMES = {
    "period_label": "Mês", "data": "Data", "descricao": "Descrição", "origem": "Origem",
    "categoria_dashboard": "Categoria", "categoria_original_excel": "Categoria original",
    "valor_real_dashboard": "Valor R$", "valor_euro_dashboard": "Valor €", "parcela_compra": "Parcela",
    "entra_custo_pessoal": "Custo pessoal", S.IS_SETTLEMENT: "Pagamento fatura", S.REASON: "Motivo exclusão",
}


def transaction_rows(ledger: DataFrame, search: str | None = None, mode: str = "literal",
                     personal_only: bool = False, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-3 rows: non-betting transactions, optional description search and
    personal-cost toggle; the export sink writes exactly this frame (D11)."""
    df = C.non_bet_rows(ledger, rules)
    df = FL.description_search(df, search or "", mode, rules)
    return C.personal_costs(df) if personal_only else df


def transaction_listing(rows: DataFrame, audit: bool = False, presentation: bool = True,
                        rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-3 view: existing columns in a fixed order (PRJ-8), dates and money as
    text (DAT-4, NUM-2), presentation names (PRJ-9)."""
    want = list(LISTING_COLUMNS) + (list(AUDIT_EXTRA) if audit else [])
    cols = []
    for c in want:
        if c not in rows.columns:
            continue
        col = F.col(c)
        if c == rules.roles.date:
            col = format_date(col)
        elif c == rules.roles.amount:
            col = format_money(col, "R$")
        elif c == rules.roles.amount_alt:
            col = format_money(col, "€")
        name = PRESENTATION_NAMES.get(c, c) if presentation else c
        cols.append(col.alias(name))
    return rows.select(*cols)


def transaction_metrics(rows: DataFrame, rules: LedgerRules = DEFAULT_RULES, order_col: str | None = None) -> DataFrame:
    """MRT-3 metrics: row count, total, alternate-currency total and the largest
    absolute amount with its description cut to 32 characters (AGG-12)."""
    r = rules.roles
    amount = F.col(r.amount) if r.amount in rows.columns else F.lit(None).cast("decimal(28,8)")
    alt = F.col(r.amount_alt) if r.amount_alt in rows.columns else F.lit(None).cast("decimal(28,8)")
    label = F.col(r.description).cast("string") if r.description in rows.columns else F.lit(None).cast("string")
    tie = -F.col(order_col).cast("long") if order_col else F.lit(0)
    pick = F.max_by(F.struct(amount.alias("v"), label.alias("l")),
                    F.when(amount.isNotNull(), F.struct(F.abs(amount), tie)))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        _dbl(sum0(amount)).alias("total"),
        _dbl(sum0(alt)).alias("total_alt"),
        pick.alias("m"),
    ).select("row_count", "total", "total_alt",
             _dbl(F.coalesce(F.col("m.v"), F.lit(0))).alias("largest_value"),
             truncate(F.coalesce(F.col("m.l"), F.lit("Sem descrição")), 32).alias("largest_label"))


# ------------------------------------------------------------------ MRT-4

def accrual_with_card(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-4 base: accrual costs plus the card statement as one more category (SET-1)."""
    return A.union_all(C.accrual_costs(ledger, rules), A.card_statement(ledger, rules))


def category_period_sums(ledger: DataFrame, periods=None, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-4 base, aggregated first: accrual costs (after the shared-home share)
    per (period, category) plus the card statement per period as one more
    category (SET-1). Two column-pruned scans and two partial aggregations.

    The result has one row per (period, category), bounded by the calendar
    times the category list, not by the ledger. It is lazy; a caller that
    needs several category metrics computes it once (a written table) and
    passes it to each of them as ``sums``.
    """
    cat, amount = rules.roles.category, rules.roles.amount
    scoped = FL.period_filter(ledger, periods)
    acc = C.accrual_costs(scoped, rules).groupBy(S.PERIOD, cat).agg(sum0(F.col(amount)).alias("value"))
    card = A.card_statement(scoped, rules).select(S.PERIOD, cat, F.col(amount).alias("value"))
    return A.union_all(acc, card)


def _sums(ledger: DataFrame | None, periods, rules: LedgerRules, sums: DataFrame | None) -> DataFrame:
    return category_period_sums(ledger, periods, rules) if sums is None else FL.period_filter(sums, periods)


def _visible(sums: DataFrame, rules: LedgerRules, show_technical: bool = False) -> DataFrame:
    """FLT-13 on the aggregated frame (technical is a property of the category)."""
    return FL.exclude_technical(sums, rules, show_technical)


def category_ranking(ledger: DataFrame | None, periods=None, show_technical: bool = False,
                     rules: LedgerRules = DEFAULT_RULES, sums: DataFrame | None = None) -> DataFrame:
    """MRT-4: accrual + card spend by category, technical categories hidden
    unless nothing else is left, largest first, with the accrual note."""
    cat = rules.roles.category
    by_cat = _category_sums(_visible(_sums(ledger, periods, rules, sums), rules, show_technical), rules)
    return (by_cat.select(F.col(cat).alias("category"), _dbl(F.col("value")).alias("value"),
                          C.category_note(F.col(cat), "accrual").alias("note"))
            .orderBy(desc_last("value"), asc_last("category")))


def _category_sums(visible: DataFrame, rules: LedgerRules) -> DataFrame:
    return A.sum_by(visible, rules.roles.category, "value", "value")


def _periods_present(df: DataFrame) -> DataFrame:
    p = F.col(S.PERIOD)
    return df.where(p.isNotNull() & (p != "")).select(S.PERIOD).distinct()


def category_headline(ledger: DataFrame | None, dim_months: DataFrame, periods=None, k: int = 3,
                      rules: LedgerRules = DEFAULT_RULES, sums: DataFrame | None = None) -> DataFrame:
    """MRT-4 metrics: leader, top-k total and names, spend, revenue of the periods
    present and the % of revenue committed."""
    cat = rules.roles.category
    sums_all = _sums(ledger, periods, rules, sums)
    visible = _visible(sums_all, rules)
    top = A.top_k(_category_sums(visible, rules).withColumnRenamed(cat, "category"), k, "value", "category")
    rev = monthly_revenue(dim_months).join(_periods_present(sums_all), S.PERIOD, "left_semi")
    spent = visible.select(_dbl(sum0(F.col("value")))).scalar()
    revenue = rev.select(_dbl(sum0(F.col("revenue")))).scalar()
    # ``top`` holds at most k rows, so this list is bounded by k.
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("category").alias("c"))))
    heads = top.agg(
        F.element_at(ordered, 1).getField("c").alias("leader"),
        _dbl(F.max("value")).alias("leader_value"),
        _dbl(sum0(F.col("value"))).alias("top_total"),
        F.array_join(F.transform(ordered, lambda s: s.getField("c")), " | ").alias("top_names"))
    return (heads.withColumn("spent", spent).withColumn("revenue", revenue)
            .withColumn("committed_pct", guarded_pct(F.col("spent"), F.col("revenue"))))


DEFAULT_COMPARED = 5


def category_evolution(ledger: DataFrame | None, dim_months: DataFrame, categories=None, periods=None,
                       with_revenue: bool = True, rules: LedgerRules = DEFAULT_RULES,
                       sums: DataFrame | None = None) -> DataFrame:
    """MRT-4: spend per (period, category) for the chosen categories, plus the
    monthly revenue as its own series (SET-2). Without a choice the five
    largest categories are compared."""
    cat = rules.roles.category
    sums_all = _sums(ledger, periods, rules, sums)
    visible = _visible(sums_all, rules)
    if categories:
        visible = visible.where(F.col(cat).isin(list(categories)))
    else:
        largest = A.top_k(_category_sums(visible, rules), DEFAULT_COMPARED, "value", cat)
        visible = FL.semi_join_values(visible, cat, largest.select(cat))
    evo = A.sum_by(visible, [S.PERIOD, cat], "value", "value").select(
        S.PERIOD, F.col(cat).alias("category"), _dbl(F.col("value")).alias("value"))
    if with_revenue:
        rev = monthly_revenue(dim_months).join(_periods_present(sums_all), S.PERIOD, "left_semi").select(
            S.PERIOD, F.lit(R.REVENUE_LABEL).alias("category"), _dbl(F.col("revenue")).alias("value"))
        evo = A.union_all(evo, rev)
    return (evo.withColumn(S.PERIOD_LABEL, month_label(F.col(S.PERIOD)))
            .withColumn("value_text", format_money(F.col("value")))
            .orderBy(S.PERIOD, "category"))


def category_means(evolution: DataFrame) -> DataFrame:
    """AGG-10 per series of an evolution: the mean of its months."""
    exact = evolution.withColumn("value", F.col("value").cast("decimal(28,8)"))  # no order of summation matters
    out = A.mean_by(exact, "category", "value")
    return out.withColumn("mean_text", format_money(F.col("mean"))).orderBy("category")


def category_revenue_table(ledger: DataFrame | None, dim_months: DataFrame, periods=None, show_technical: bool = False,
                           rules: LedgerRules = DEFAULT_RULES, sums: DataFrame | None = None) -> DataFrame:
    """MRT-6 over the aggregated category frame (see :func:`category_revenue`)."""
    visible = _visible(_sums(ledger, periods, rules, sums), rules, show_technical)
    return category_revenue(visible, dim_months, rules, value_col="value")


# ------------------------------------------------------------------ MRT-5

def source_spend(ledger: DataFrame, periods=None, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-5: personal cost by account, largest first, with the number of card
    settlement rows of the selection on every row (AGG-11)."""
    acc, amount = rules.roles.account, rules.roles.amount
    sel = FL.period_filter(ledger, periods)
    settlements = sel.select(F.count_if(flag_or(sel, S.IS_SETTLEMENT))).scalar()
    by_src = A.sum_by(C.personal_costs(sel), acc, amount, "value")
    return (by_src
            .select(F.col(acc).alias("source"), _dbl(F.col("value")).alias("value"),
                    settlements.alias("settlement_rows"))
            .orderBy(desc_last("value"), asc_last("source")))


# ------------------------------------------------------------------ MRT-6

def category_revenue(personal: DataFrame, dim_months: DataFrame, rules: LedgerRules = DEFAULT_RULES,
                     value_col: str | None = None) -> DataFrame:
    """MRT-6: per month, the revenue row first (100 %) and each category's spend
    with its share of that month's revenue (0 when there is none). ``personal``
    holds cost rows (or already aggregated rows, naming their ``value_col``)."""
    cat, amount = rules.roles.category, value_col or rules.roles.amount
    rev = monthly_revenue(dim_months).join(_periods_present(personal), S.PERIOD, "left_semi")
    costs = (A.sum_by(personal, [S.PERIOD, cat], amount, "value")
             .join(rev, S.PERIOD, "left")
             .select(S.PERIOD, F.col(cat).alias("category"), _dbl(F.col("value")).alias("value"),
                     guarded_pct(F.col("value"), F.col("revenue")).alias("revenue_pct"),
                     F.lit(1).alias("row_order")))
    rev_rows = rev.select(S.PERIOD, F.lit(R.REVENUE_LABEL).alias("category"),
                          _dbl(F.col("revenue")).alias("value"), F.lit(100.0).alias("revenue_pct"),
                          F.lit(0).alias("row_order"))
    table = A.union_all(rev_rows, costs)
    return (table.select(S.PERIOD, month_label(F.col(S.PERIOD)).alias(S.PERIOD_LABEL), "category", "value",
                         "revenue_pct", "row_order",
                         format_money(F.col("value")).alias("value_text"),
                         format_pct(F.col("revenue_pct")).alias("revenue_pct_text"))
            .orderBy(S.PERIOD, "row_order", desc_last("value"), asc_last("category")))


# ------------------------------------------------------------------ MRT-7 / MRT-8

def receivable_rows(items: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-7 detail rows: non-total items with a receivable term; rebates are
    negative, house items positive; the period travels with the label (D15)."""
    value_col = S.value_column(items, rules.roles.amount, rules.roles.value_terms)
    schema = (f"{S.PERIOD} string, {S.PERIOD_LABEL} string, item string, kind string, value decimal(38,8), "
              "row_order int, item_text_norm string")
    if value_col is None:
        return items.sparkSession.createDataFrame([], schema)
    clean = items.where(~flag_or(items, S.IS_TOTAL))
    item_col = S.item_column(clean, rules.roles.item, rules.roles.item_candidates)
    if item_col is None:
        return items.sparkSession.createDataFrame([], schema)
    kept = FL.receivable_items(clean, item_col, rules)
    rebate = F.col("is_rebate")
    magnitude = F.abs(F.coalesce(F.col(value_col), F.lit(0)))
    label = F.col(S.PERIOD_LABEL) if S.PERIOD_LABEL in kept.columns else F.lit(R.NO_MONTH_LABEL)
    period = F.col(S.PERIOD) if S.PERIOD in kept.columns else F.lit(None).cast("string")
    return kept.select(
        period.alias(S.PERIOD), label.alias(S.PERIOD_LABEL),
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.when(rebate, F.lit(R.RECEIVABLE_REBATE_TYPE)).otherwise(F.lit(R.RECEIVABLE_HOUSE_TYPE)).alias("kind"),
        F.when(rebate, -magnitude).otherwise(magnitude).alias("value"),
        F.when(rebate, F.lit(1)).otherwise(F.lit(0)).alias("row_order"),
        F.col("item_text_norm"))


def receivable_statement(items: DataFrame, rules: LedgerRules = DEFAULT_RULES, ordered: bool = False) -> DataFrame:
    """MRT-7 + AGG-8: every detail row as it is, and one total row per month. ``ordered`` sorts all rows
    by month, details before the total, then item: a shuffle of every row, for presentation."""
    rows = receivable_rows(items, rules).drop("item_text_norm")
    totals = (rows.groupBy(S.PERIOD, S.PERIOD_LABEL).agg(sum0(F.col("value")).alias("value"))
              .select(S.PERIOD, S.PERIOD_LABEL, F.lit(R.RECEIVABLE_TOTAL_ITEM).alias("item"),
                      F.lit(R.RECEIVABLE_TOTAL_TYPE).alias("kind"), F.lit(2).alias("row_order"), "value"))
    out = A.union_all(rows, totals).select(S.PERIOD, S.PERIOD_LABEL, "item", "kind", _dbl(F.col("value")).alias("value"), "row_order")
    return out.orderBy(asc_last(S.PERIOD), "row_order", "item") if ordered else out


def receivable_view(items: DataFrame, rules: LedgerRules = DEFAULT_RULES, ordered: bool = False) -> DataFrame:
    """MRT-7 detail by group (FLT-18). ``ordered`` sorts all rows by month, group (alphabetically), type in
    its fixed order (SRT-5) and item: a shuffle of every row, for presentation."""
    rows = receivable_rows(items, rules)
    group = C.receivable_group(F.col("item_text_norm"), F.col("kind"), F.col("value"), rules, item_normalized=True)
    out = rows.select(group.alias("group"), S.PERIOD, S.PERIOD_LABEL, "item", "kind", _dbl(F.col("value")).alias("value"),
                      A.rank_of(F.col("kind"), rules.type_order).alias("type_order"))
    return out.orderBy(asc_last(S.PERIOD), "group", "type_order", "item") if ordered else out


def receivable_totals(items: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-7 monthly totals with change vs the previous month (WIN-1, WIN-2)."""
    rows = receivable_rows(items, rules)
    totals = (rows.groupBy(S.PERIOD, S.PERIOD_LABEL).agg(sum0(F.col("value")).alias("value"))
              .select(S.PERIOD, S.PERIOD_LABEL, _dbl(F.col("value")).alias("value")))
    return A.with_change(totals, "value").orderBy(asc_last(S.PERIOD))


def receivable_summary(items: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-7 metrics: period total, monthly mean, last month, change vs the
    month before, first-to-last % (WIN-3)."""
    rows = receivable_rows(items, rules)
    exact = rows.groupBy(S.PERIOD).agg(sum0(F.col("value")).alias("exact"))
    totals = A.with_change(exact.withColumn("value", _dbl(F.col("exact"))), "value")
    first = F.min_by("value", S.PERIOD)
    last = F.max_by("value", S.PERIOD)
    return totals.agg(_dbl(sum0(F.col("exact"))).alias("period_total"), A.mean(F.col("exact")).alias("monthly_mean"),
                      last.alias("last_value"), F.max_by("change", S.PERIOD).alias("last_change"),
                      first.alias("first_value"), F.count(F.lit(1)).alias("months")).withColumn(
        "first_last_pct",
        F.when(F.coalesce(F.col("first_value"), F.lit(0.0)) == 0, F.lit(None).cast("double"))
        .otherwise((F.col("last_value") - F.col("first_value")) / F.abs(F.col("first_value")) * 100.0))


def receivable_detail(items: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-8: sum per (group, item, kind) with a subtotal per group and a grand
    total in one GROUPING SETS aggregation, in the fixed group order."""
    rows = receivable_rows(items, rules)
    grouped = rows.withColumn("group", C.receivable_group(F.col("item_text_norm"), F.col("kind"), F.col("value"), rules,
                                                          item_normalized=True))
    sums = A.subtotals(grouped, ["group", "item", "kind"], "value", "value")
    return (sums.select("group", "item", "kind", "level", _dbl(F.col("value")).alias("value"),
                        A.rank_of(F.col("group"), R.GROUP_ORDER).alias("group_order"))
            .orderBy(F.when(F.col("level") == 2, 1).otherwise(0), "group_order", "group", "level",
                     asc_last("item"), asc_last("kind")))


# ------------------------------------------------------------------ MRT-9 / MRT-10

def house_costs(rent: DataFrame, ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-9: rent items plus ledger rows of the house raw category, each tagged
    with its source, total lines removed."""
    r = rules.roles
    cols = f"{S.PERIOD} string, {S.PERIOD_LABEL} string, rubrica string, valor_real_dashboard decimal(38,8), fonte_dado string"
    parts = []
    if rent.columns:
        clean = rent.where(~flag_or(rent, S.IS_TOTAL))
        value_col = S.value_column(clean, r.amount, r.value_terms)
        item_col = S.item_column(clean, r.rubric, r.item_candidates)
        if value_col and item_col and S.PERIOD in clean.columns:
            parts.append(clean.select(S.PERIOD, S.PERIOD_LABEL, F.col(item_col).cast("string").alias("rubrica"),
                                      F.col(value_col).alias("valor_real_dashboard"),
                                      F.lit(R.HOUSE_SOURCE_RENT).alias("fonte_dado")))
    if ledger.columns:
        tx = FL.raw_category_is(ledger, rules.house_raw_category, rules)
        tx = tx.where(~flag_or(tx, S.IS_TOTAL))
        item_col = S.item_column(tx, r.cost_name, r.item_candidates)
        if item_col and r.amount in tx.columns:
            parts.append(tx.select(S.PERIOD, S.PERIOD_LABEL, F.col(item_col).cast("string").alias("rubrica"),
                                   F.col(r.amount).alias("valor_real_dashboard"),
                                   F.lit(R.HOUSE_SOURCE_TX).alias("fonte_dado")))
    if not parts:
        return ledger.sparkSession.createDataFrame([], cols)
    return A.union_all(*parts).withColumn(S.IS_TOTAL, F.lit(False))


def utility_monthly(items: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """AGG-14 + FLT-15: utilities per (period, class), grossed up by the factor
    (the half share back to the whole bill). Total lines are not removed."""
    r = rules.roles
    value_col = S.value_column(items, r.amount, r.value_terms)
    item_col = S.item_column(items, r.item, r.item_candidates)
    if value_col is None or item_col is None:
        return items.sparkSession.createDataFrame([], f"{S.PERIOD} string, {S.PERIOD_LABEL} string, bill string, value double")
    return (_utility_sums(items, rules)
            .select(S.PERIOD, S.PERIOD_LABEL, "bill", _dbl(F.col("value")).alias("value"))
            .orderBy(S.PERIOD, "bill"))


def _utility_sums(items: DataFrame, rules: LedgerRules) -> DataFrame:
    r = rules.roles
    value_col = S.value_column(items, r.amount, r.value_terms)
    item_col = S.item_column(items, r.item, r.item_candidates)
    twin = S.norm(item_col)
    staged = items.withColumn("__item_n", F.coalesce(F.col(twin), F.lit("")) if twin in items.columns
                              else normalize(item_col))
    classed = staged.withColumn("bill", FL.utility_class(F.col("__item_n"), rules, normalized=True))
    return (classed.where(F.col("bill").isNotNull() & F.col(S.PERIOD).isNotNull())
            .groupBy(S.PERIOD, S.PERIOD_LABEL, "bill")
            .agg((sum0(F.col(value_col)) * F.lit(rules.utility_factor)).alias("value")))


def item_summary(items: DataFrame, utilities_from: DataFrame | None = None, item_fallback: str = "item",
                 rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-10 metrics: total, latest month, monthly mean, distinct items and,
    when a utility table is given, utilities as % of the total."""
    r = rules.roles
    value_col = S.value_column(items, r.amount, r.value_terms)
    if value_col is None or S.PERIOD not in items.columns:
        extra = ", utilities double, utilities_pct double" if utilities_from is not None else ""
        return items.sparkSession.createDataFrame(
            [], f"total double, distinct_items long, last_month double, monthly_mean double{extra}")
    clean = items.where(~flag_or(items, S.IS_TOTAL))
    item_col = S.item_column(clean, item_fallback, r.item_candidates)
    # One aggregation per period (the NULL period kept for the total) gives the total, last month and mean.
    per_period = clean.groupBy(S.PERIOD).agg(sum0(F.col(value_col)).alias("value"))
    month = F.when(F.col(S.PERIOD).isNotNull(), F.col("value"))
    count = F.count_distinct(F.col(item_col)) if item_col else F.count(F.lit(1))
    out = per_period.agg(
        _dbl(sum0(F.col("value"))).alias("total"), clean.select(count).scalar().alias("distinct_items"),
        _dbl(F.coalesce(F.max_by(month, S.PERIOD), F.lit(0))).alias("last_month"),
        F.coalesce(A.mean(month), F.lit(0.0)).alias("monthly_mean"))
    if utilities_from is not None:
        util = _utility_sums(utilities_from, rules).select(_dbl(sum0(F.col("value")))).scalar()
        out = out.withColumn("utilities", util).withColumn(
            "utilities_pct", guarded_pct(F.col("utilities"), F.col("total")))
    return out


def item_detail(items: DataFrame, item_fallback: str = "item", by_source: bool = True,
                rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """AGG-6: sum per (month, item[, source]), month ascending, value descending."""
    r = rules.roles
    value_col = S.value_column(items, r.amount, r.value_terms)
    clean = items.where(~flag_or(items, S.IS_TOTAL))
    item_col = S.item_column(clean, item_fallback, r.item_candidates)
    if value_col is None or item_col is None or S.PERIOD not in items.columns:
        source = "fonte_dado string, " if by_source and "fonte_dado" in clean.columns else ""
        return items.sparkSession.createDataFrame(
            [], f"{S.PERIOD} string, {S.PERIOD_LABEL} string, item string, {source}value double, value_text string")
    keys = [S.PERIOD, S.PERIOD_LABEL, item_col] + (["fonte_dado"] if by_source and "fonte_dado" in clean.columns else [])
    out = (clean.where(F.col(item_col).isNotNull()).groupBy(*keys).agg(sum0(F.col(value_col)).alias("value"))
           .withColumnRenamed(item_col, "item"))
    return (out.withColumn("value", _dbl(F.col("value")))
            .withColumn("value_text", format_money(F.col("value")))
            .orderBy(asc_last(S.PERIOD), desc_last("value"), "item"))


# ------------------------------------------------------------------ MRT-11

def bet_ledger(ledger: DataFrame, betting: DataFrame | None = None, key: str = S.PERIOD,
               rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-11: staked, returned, balance and running balance per period.

    Source: betting rows of the ledger (stakes and payouts, total lines out),
    summed in one pass (JON-2). When the ledger has none, the betting table
    is used instead, classified by its type text (D13); the caller passes it
    already filtered (D14). The switch is an EXISTS subquery, decided on the
    cluster. ``key`` may name another grain (e.g. a day column); the running
    balance orders its values in one task, so it must be one whose values are
    bounded by the calendar.
    """
    amount = rules.roles.amount
    primary = _bet_primary(ledger, key, rules)
    if betting is None:
        out = primary
    else:
        if primary is None:
            out = _bet_fallback(betting, key, rules)
        else:  # tested on the fallback's rows, below its aggregation
            unused = betting.where(~_bet_rows(ledger, key).exists())
            out = primary.unionByName(_bet_fallback(unused, key, rules))
    out = out.withColumn("balance", F.col("returned") - F.col("staked"))
    out = A.running_sum(out, "balance", "running_balance", key)
    return out.select(
        F.col(key).alias(S.PERIOD), month_label(F.col(key)).alias(S.PERIOD_LABEL),
        _dbl(F.col("staked")).alias("staked"), _dbl(F.col("returned")).alias("returned"),
        _dbl(F.col("balance")).alias("balance"), _dbl(F.col("running_balance")).alias("running_balance"),
    ).orderBy(S.PERIOD)


def _bet_rows(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.where((F.col(S.IS_STAKE) | F.col(S.IS_PAYOUT)) & ~flag_or(ledger, S.IS_TOTAL) & F.col(key).isNotNull())


def _bet_primary(ledger: DataFrame, key: str, rules: LedgerRules):
    amount = rules.roles.amount
    need = {S.IS_STAKE, S.IS_PAYOUT, amount, key}
    if not need.issubset(ledger.columns):
        return None
    return _bet_rows(ledger, key).groupBy(key).agg(sum0(F.when(F.col(S.IS_STAKE), F.col(amount))).alias("staked"),
                                 sum0(F.when(F.col(S.IS_PAYOUT), F.col(amount))).alias("returned"))


def _bet_fallback(betting: DataFrame, key: str, rules: LedgerRules) -> DataFrame:
    r = rules.roles
    value_col = S.value_column(betting, r.amount, r.value_terms)
    if value_col is None or key not in betting.columns:
        return betting.sparkSession.createDataFrame([], f"{key} string, staked decimal(38,8), returned decimal(38,8)")
    clean = betting.where(~flag_or(betting, S.IS_TOTAL))
    kind = S.norm(r.kind) if S.norm(r.kind) in clean.columns else S.norm(r.description)
    text = F.coalesce(F.col(kind), F.lit("")) if kind in clean.columns else F.lit("")
    stake = text.rlike(rules.bet_fallback_stake)
    payout = text.rlike(rules.bet_fallback_payout)
    if rules.exclusive_bet_fallback:
        stake = stake & ~payout
    v = F.col(value_col)
    return (clean.where(F.col(key).isNotNull()).groupBy(key)
            .agg(sum0(F.when(stake, v)).alias("staked"), sum0(F.when(payout, v)).alias("returned")))


def bet_detail(ledger: DataFrame, rules: LedgerRules = DEFAULT_RULES) -> DataFrame:
    """MRT-11 detail: each betting row with its type label, staked and returned
    amounts as money text or a dash (PRJ-11, NUM-7)."""
    r = rules.roles
    rows = ledger.where((F.col(S.IS_STAKE) | F.col(S.IS_PAYOUT)) & ~flag_or(ledger, S.IS_TOTAL))
    rows = C.split_bet_measures(rows, rules)
    alt = F.col(r.amount_alt) if r.amount_alt in rows.columns else F.lit(0)
    out = rows.select(
        S.PERIOD, S.PERIOD_LABEL,
        (format_date(F.col(r.date)) if r.date in rows.columns else F.lit(None).cast("string")).alias("date_text"),
        "bet_type",
        (F.col(r.description) if r.description in rows.columns else F.lit(None).cast("string")).alias("description"),
        (F.col(r.account) if r.account in rows.columns else F.lit(None).cast("string")).alias("source"),
        (F.col(r.category) if r.category in rows.columns else F.lit(None).cast("string")).alias("category"),
        _dbl(F.col("staked")).alias("staked"), _dbl(F.col("returned")).alias("returned"),
        money_or_dash(F.col("staked")).alias("staked_text"),
        money_or_dash(F.col("returned")).alias("returned_text"),
        format_money(alt, "€").alias("alt_text"),
        (F.col(r.date) if r.date in rows.columns else F.lit(None).cast("date")).alias("__date"))
    return out.orderBy(asc_last(S.PERIOD), asc_last("__date"), "bet_type", asc_last("description")).drop("__date")
