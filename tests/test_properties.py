"""Invariants of SURVEY section 5 on the smallest test tables."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from razao import schema as S
from razao.functions import numbers as N
from razao.operators import classify as C
from razao.plans import audit, marts
from razao.plans import catalogue as K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
AMT = "valor_real_dashboard"


@pytest.fixture(scope="module")
def ledger(spark):
    return K.ledger(spark, SF)


def test_included_plus_excluded_is_gross(ledger):
    for r in audit.audit_months(ledger).collect():
        assert abs(r.personal + r.excluded - r.gross) < 1e-6


def test_cost_views_hold_no_bets_or_totals(ledger):
    for view in (C.cash_costs(ledger), C.accrual_costs(ledger), C.personal_costs(ledger)):
        bad = view.where(F.col(S.IS_STAKE) | F.col(S.IS_PAYOUT) | F.col(S.IS_TOTAL)).count()
        assert bad == 0


def test_shares_sum_to_100(ledger):
    total = sum(r.share_pct for r in audit.audit_categories(ledger).collect())
    assert abs(total - 100.0) < 1e-6


def test_top_k_plus_others_is_total(ledger):
    cash_total = float(C.cash_costs(ledger).agg(F.sum(AMT)).first()[0])
    for k in (1, 3, 5):
        assert abs(sum(r.value for r in marts.cash_by_category(ledger, k=k).collect()) - cash_total) < 1e-6


def test_last_running_balance_is_sum_of_balances(spark, ledger):
    rows = marts.bet_ledger(ledger, K.betting(spark, SF)).collect()
    assert rows and abs(rows[-1].running_balance - sum(r.balance for r in rows)) < 1e-6


@settings(max_examples=10, deadline=None)
@given(st.lists(st.decimals(min_value=Decimal("-99999999.99"), max_value=Decimal("99999999.99"), places=2),
                min_size=1, max_size=25))
def test_parse_of_format_is_identity(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,2)")
    back = [r[0] for r in df.select(N.parse_number(N.format_money(F.col("x")))).collect()]
    assert back == [Decimal(v) for v in values]
