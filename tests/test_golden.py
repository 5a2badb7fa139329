"""Golden results of FIXTURES.md section 3 on the demo workbook."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from razao.operators import aggregates as A
from razao.operators import classify as C
from razao.plans import audit, marts, quality
from razao.rules import LedgerRules

AMT = "valor_real_dashboard"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def money(x):
    return round(float(x), 2)


def test_personal_costs(demo):
    p = C.personal_costs(demo["fact_transacoes"])
    assert p.count() == 7
    assert money(p.agg(F.sum(AMT)).first()[0]) == 3910


def test_exclusion_reasons(demo):
    got = {r[0]: (r[1], money(r[2])) for r in rows(audit.audit_exclusions(demo["fact_transacoes"]),
                                                  "exclusion_reason", "row_count", "total")}
    assert got == {"total/subtotal": (1, 1180), "categoria Bet": (1, 250), "categoria Bet retorno": (1, 140)}


def test_audit_summary_and_counts(demo):
    s = [money(v) for v in [r["value"] for r in audit.audit_summary(demo["fact_transacoes"]).collect()]]
    assert s == [10, 9, 1, 5480, 3910]
    c = audit.audit_counts(demo["fact_transacoes"]).first()
    assert (c.rows_loaded, c.rows_counted, c.rows_excluded, money(c.excluded_value)) == (10, 7, 3, 1570)


def test_audit_months(demo):
    got = {r[0]: tuple(money(x) for x in r[1:]) for r in rows(
        audit.audit_months(demo["fact_transacoes"]), "period", "gross", "personal", "excluded", "staked", "returned")}
    assert got == {"2026-01": (2340, 2340, 0, 0, 0), "2026-02": (780, 390, 390, 250, 140),
                   "2026-03": (2360, 1180, 1180, 0, 0)}


def test_audit_categories_and_sources(demo):
    cats = {r[0]: (r[1], money(r[2]), round(r[3], 2)) for r in rows(
        audit.audit_categories(demo["fact_transacoes"]), "category", "row_count", "total", "share_pct")}
    assert cats["Mercado"] == (2, 1770, 45.27)
    assert cats["Cartão de Crédito"] == (1, 1170, 29.92)
    assert cats["Educação"] == (1, 180, 4.60)
    srcs = {r[0]: (r[1], money(r[2])) for r in rows(audit.audit_sources(demo["fact_transacoes"]),
                                                   "source", "row_count", "total")}
    assert srcs == {"Conta Corrente": (4, 3150), "Cartão de Crédito": (3, 760)}


def test_cash_and_accrual_by_month(demo):
    tx = demo["fact_transacoes"]
    cash = {r[0]: money(r[1]) for r in rows(A.monthly_sum(C.cash_costs(tx), AMT), "period", "value")}
    assert cash == {"2026-01": 2020, "2026-02": 210, "2026-03": 920}
    acc = {r[0]: money(r[1]) for r in rows(A.monthly_sum(C.accrual_costs(tx), AMT), "period", "value")}
    assert acc == {"2026-01": 1170, "2026-02": 390, "2026-03": 1180}


def test_card_statement(demo):
    got = {r[0]: money(r[1]) for r in rows(A.card_statement(demo["fact_transacoes"]), "period", AMT)}
    assert got == {"2026-01": 320, "2026-02": 180, "2026-03": 260}


def test_category_ranking_and_headline(demo):
    tx, rev = demo["fact_transacoes"], demo["dim_meses"]
    got = {r[0]: money(r[1]) for r in rows(marts.category_ranking(tx), "category", "value")}
    assert got == {"Mercado": 1770, "Cartão de Crédito": 760, "Lazer": 320, "Transporte": 260,
                   "Saúde": 210, "Educação": 180}
    h = marts.category_headline(tx, rev).first()
    assert h.leader == "Mercado" and money(h.spent) == 3500 and money(h.revenue) == 36500
    assert round(h.committed_pct, 2) == 9.59
    assert h.top_names == "Mercado | Cartão de Crédito | Lazer"


def test_overview(demo):
    tx, rev = demo["fact_transacoes"], demo["dim_meses"]
    march = marts.cash_flow_summary(tx, rev, ["2026-03"]).first()
    assert (money(march.revenue), money(march.cash_out), money(march.balance)) == (12500, 920, 11580)
    assert round(march.consumed_pct, 2) == 7.36
    delta = marts.cash_flow_monthly(tx, rev, ["2026-03"]).first()
    assert money(delta.change_vs_previous) == 710
    assert money(march.change_vs_previous) == 710
    last = marts.cash_flow_summary(tx, rev).first()
    assert last == march
    allm = marts.cash_flow_summary(tx, rev, ["2026-01", "2026-02", "2026-03"]).first()
    assert allm.change_vs_previous is None
    assert (money(allm.revenue), money(allm.cash_out), money(allm.balance)) == (36500, 3150, 33350)
    assert round(allm.consumed_pct, 2) == 8.63


def test_cash_by_source(demo):
    got = {r[0]: money(r[1]) for r in rows(marts.cash_by_source(demo["fact_transacoes"]), "source", "value")}
    assert got == {"Conta Corrente": 1980, "Cartão de Crédito": 1170}


def test_category_revenue_january(demo):
    from razao.operators import filters as FL
    base = FL.exclude_technical(marts.accrual_with_card(demo["fact_transacoes"]))
    t = marts.category_revenue(base, demo["dim_meses"]).where(F.col("period") == "2026-01")
    got = {r[0]: (money(r[1]), round(r[2], 2)) for r in rows(t, "category", "value", "revenue_pct")}
    assert got == {"Receita mensal": (12000, 100.0), "Mercado": (850, 7.08), "Lazer": (320, 2.67),
                   "Cartão de Crédito": (320, 2.67)}
    first = t.first()
    assert first.category == "Receita mensal" and first.revenue_pct_text == "100,0%"


def test_transaction_metrics(demo):
    r = marts.transaction_metrics(marts.transaction_rows(demo["fact_transacoes"])).first()
    assert (r.row_count, money(r.total), money(r.total_alt), money(r.largest_value)) == (8, 5090, 869, 1180)
    assert r.largest_label == "Total março"


def test_receivables(demo):
    items = demo["fact_marta"]
    totals = {r[0]: money(r[1]) for r in rows(marts.receivable_totals(items), "period", "value")}
    assert totals == {"2026-01": 2640, "2026-02": 2710, "2026-03": 2865}
    s = marts.receivable_summary(items).first()
    assert money(s.period_total) == 8215 and round(s.monthly_mean, 2) == 2738.33
    assert round(s.first_last_pct, 2) == 8.52
    ch = {r[0]: (money(r[1]), round(r[2], 2)) for r in rows(marts.receivable_totals(items).where(
        F.col("change").isNotNull()), "period", "change", "change_pct")}
    assert ch == {"2026-02": (70, 2.65), "2026-03": (155, 5.72)}
    d = marts.receivable_detail(items)
    groups = {r[0]: money(r[1]) for r in rows(d.where(F.col("level") == 1), "group", "value")}
    assert groups == {"Custos partilhados": 8710, "Custos exclusivos Marta": 45, "Abatimentos": -540}
    assert money(d.where(F.col("level") == 2).first().value) == 8215


def test_house_costs_and_utilities(demo):
    house = marts.house_costs(demo["fact_aluguel"], demo["fact_transacoes"])
    s = marts.item_summary(house, demo["fact_marta"], "rubrica").first()
    assert money(s.total) == 15935 and round(s.monthly_mean, 2) == 5311.67 and s.distinct_items == 4
    assert money(s.utilities) == 1460 and round(s.utilities_pct, 2) == 9.16
    util = {(r[0], r[1]): money(r[2]) for r in rows(marts.utility_monthly(demo["fact_marta"]), "period", "bill", "value")}
    assert util == {("2026-01", "Internet + TV"): 240, ("2026-02", "Luz"): 320, ("2026-02", "Gás"): 140,
                    ("2026-02", "Celular"): 90, ("2026-03", "Internet + TV"): 240, ("2026-03", "Luz"): 300,
                    ("2026-03", "Gás"): 130}


def _bets(df):
    return [(r.period, money(r.staked), money(r.returned), money(r.balance), money(r.running_balance))
            for r in df.collect()]


def test_bet_ledger(demo):
    tx, kto = demo["fact_transacoes"], demo["fact_apostas_kto"]
    assert _bets(marts.bet_ledger(tx, kto)) == [("2026-02", 250, 140, -110, -110)]
    no_bets = C.non_bet_rows(tx)
    assert _bets(marts.bet_ledger(no_bets, kto)) == [("2026-02", 390, 140, -250, -250),
                                                     ("2026-03", 100, 0, -100, -350)]
    strict = LedgerRules(exclusive_bet_fallback=True)
    assert _bets(marts.bet_ledger(no_bets, kto, rules=strict)) == [("2026-02", 250, 140, -110, -110),
                                                                   ("2026-03", 100, 0, -100, -210)]


def test_quality_report(spark, demo):
    issues = quality.quality_issues(spark, demo).collect()
    got = [(r.table_name, r.message) for r in issues]
    assert got == [
        ("fact_transacoes", "1 linha(s) parecem total/subtotal e serão ignoradas nos cálculos."),
        ("dim_categorias", "7 linha(s) sem mês reconhecido."),
        ("fact_marta", "1 linha(s) parecem total/subtotal e serão ignoradas nos cálculos."),
        ("fact_aluguel", "1 linha(s) parecem total/subtotal e serão ignoradas nos cálculos."),
        ("README_modelo", "1 linha(s) sem mês reconhecido."),
    ]
    assert quality.quality_status(quality.quality_issues(spark, demo)).first().status == "Atenção"


def test_missing_table_is_reported(spark, demo):
    partial = {k: v for k, v in demo.items() if k != "dim_meses"}
    msgs = [(r.table_name, r.level) for r in quality.quality_issues(spark, partial).collect()]
    assert ("dim_meses", "erro") in msgs


@pytest.mark.parametrize("k,expected", [(5, 3), (2, 3), (1, 2)])
def test_top_k_with_others(demo, k, expected):
    tx = demo["fact_transacoes"]
    out = marts.cash_by_category(tx, k=k).collect()
    assert len(out) == expected
    assert money(sum(r.value for r in out)) == 3150


def test_csv_workbook_round_trip(spark, demo_raw):
    import tempfile

    from razao.sources import ingest
    base = tempfile.mkdtemp(prefix="razao-book-", dir="/tmp")
    for name, df in demo_raw.items():
        ingest.write_csv(df.coalesce(1), f"{base}/{name}")
    book = ingest.read_workbook(spark, base, fmt="csv")
    assert set(book) == set(demo_raw)
    p = C.personal_costs(book["fact_transacoes"])
    assert money(p.agg(F.sum(AMT)).first()[0]) == 3910
    import pytest as _pytest
    with _pytest.raises(ingest.MissingTableError):
        ingest.read_workbook(spark, base, names=["missing_table"], fmt="csv")
    assert ingest.read_workbook(spark, base, names=["missing_table"], fmt="csv", missing="skip") == {}
