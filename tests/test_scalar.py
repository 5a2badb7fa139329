"""Scalar parsers and formatters on edge strings."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from razao.functions import numbers as N
from razao.functions import periods as P
from razao.functions import text as T
from razao.schema import standard_names


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


NUMBERS = [
    ("R$ 1.234,56", Decimal("1234.56")), ("(100,00)", Decimal("-100")), ("R$ (100,00)", Decimal("100")),
    ("1.170", Decimal("1.17")), ("1.170.000", None), ("1,234,567", None), ("", None), ("   ", None),
    ("1,5", Decimal("1.5")), ("abc", None), ("-", None), ("1.234.567,89", Decimal("1234567.89")),
    ("12,345.67", Decimal("12345.67")), ("R$ 100.000.000.000.000,00", Decimal("100000000000000")), ("0,123456", Decimal("0.123456")), ("€ 3,50", Decimal("3.5")), ("-12,5", Decimal("-12.5")),
    (" R$ 1.000,00 ", Decimal("1000")), (None, None),
]


def test_parse_number(spark):
    got = one_col(spark, [s for s, _ in NUMBERS], lambda c: N.parse_number(c))
    assert got == [e for _, e in NUMBERS]


def test_parse_number_paren_after_currency(spark):
    got = one_col(spark, ["R$ (100,00)"], lambda c: N.parse_number(c, paren_after_currency=True))
    assert got == [Decimal("-100")]


def test_with_numbers_matches_column_form(spark):
    df = spark.createDataFrame([(s,) for s, _ in NUMBERS], "valor string")
    got = [r[0] for r in N.with_numbers(df, ["valor"]).collect()]
    assert got == [e for _, e in NUMBERS]


MONTHS = [
    ("Janeiro", "2026-01"), ("Jan", "2026-01"), ("Fev", "2026-02"), ("Março", "2026-03"), ("3", "2026-03"),
    ("12", "2026-12"), ("13", None), ("jan/26", "2026-01"), ("fev/2026", "2026-02"), ("Março 2026", "2026-03"),
    ("2026", "2026-01"), ("03/2026", "2026-03"), ("3/2026", "2026-03"), ("2026-03", "2026-03"),
    ("Jan/2026", "2026-01"), ("May 2026", "2026-05"), ("01/02/2026", "2026-02"), ("01-02-2026", "2026-02"),
    ("1.2.2026", "2026-02"), ("02/13/2026", "2026-02"), ("20260301", "2026-03"), ("202603", None),
    ("2026-02-01", "2026-02"), ("2026-02-13", "2026-02"), ("31/02/2026", None), ("1,5", None),
    ("01/02/2026 10:30", "2026-02"), ("March 5, 2026", "2026-03"), ("5 Mar 2026", "2026-03"), ("05-Mar-2026", "2026-03"), ("March 2026", "2026-03"),
    ("Set/2025", "2025-09"), ("out mar 2026", "2026-03"), (None, None), ("", None),
]


def test_parse_month(spark):
    got = one_col(spark, [s for s, _ in MONTHS], lambda c: P.parse_month(c))
    assert got == [e for _, e in MONTHS]


def test_with_month_matches_column_form(spark):
    df = spark.createDataFrame([(s,) for s, _ in MONTHS], "mes string")
    got = [r[0] for r in P.with_month(df, "mes", "period").select("period").collect()]
    assert got == [e for _, e in MONTHS]


def test_parse_date(spark):
    import datetime as dt
    values = ["2026-01-05", "05/01/2026", "01/13/2026", "5.1.2026", "05-01-2026", "20260105", "05/01/26",
              "2026/01/05", "2026-01-05 10:00:00", "05/01/2026 10:30", "January 5, 2026", "5 Jan 2026", "05-Jan-2026", "5th jan 26",
              "Monday, January 5, 2026", "2026-01-05T10:00:00.123Z", "05/01/2026 9:05 pm", "31/02/2026", "hoje", "hoje 10:30", None]
    d = dt.date(2026, 1, 5)
    assert one_col(spark, values, P.parse_date) == [d, d, dt.date(2026, 1, 13), *[d] * 14, None, None, None, None]


def test_month_label(spark):
    got = one_col(spark, ["2026-03", "2026-13", "", None, "abc"], P.month_label)
    assert got == ["Mar/2026", "13/2026", "Sem mês", "Sem mês", "abc"]


# Texts and what they become; the last ones hold characters that decompose into several, a Hangul
# syllable, letters beyond the first plane, and capitals that only appear by decomposition.
NORMAL = [
    ("  Cartão de Crédito ", "cartao de credito"), ("ÉCOLE  naïve", "ecole naive"), ("ﬁnal … ½", "final ... 1⁄2"), ("Ĳssel  \t x", "ijssel x"),
    ("Condomínio", "condominio"), ("e\u0301tude", "etude"), ("　Ｆｕｌｌ　ｗｉｄｔｈ　", "full width"), ("a\nb\r\nc", "a b c"),
    ("Marca™ № ⅓ ㎡ ℃", "marcaTM No 1⁄3 m2 °C"), ("각 힣", "\u1100\u1161\u11a8 \u1112\u1175\u11c2"), ("𝐀𝑏𝟗", "Ab9"), ("ﷺ", "صلى الله عليه وسلم"),
    ("İstanbul", "istanbul"), ("", ""), (None, ""),
]


def test_normalize(spark):
    df = spark.createDataFrame([(t,) for t, _ in NORMAL], "s string")
    want = [n for _, n in NORMAL]
    assert [r[0] for r in df.select(T.normalize("s")).collect()] == want
    assert [r[0] for r in df.select(T.normalize(F.col("s"))).collect()] == want
    assert [T.normalize_py(t) for t, _ in NORMAL] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_leaves_nothing_to_fold(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(T.normalize("s")).collect()]
    assert got == [T.normalize_py(t) for t in texts]
    for t in got:
        assert unicodedata.normalize("NFKD", t) == t and not any(map(unicodedata.combining, t)) and "  " not in t


def test_formats(spark):
    df = spark.createDataFrame([(1234.5,), (-0.25,), (None,), (2.675,), (0.05,)], "x double")
    r = df.select(N.format_money(F.col("x")).alias("m"), N.format_pct(F.col("x")).alias("p"),
                  N.money_or_dash(F.col("x")).alias("d"), N.sign_class(F.col("x")).alias("s")).collect()
    assert [x.m for x in r] == ["R$ 1.234,50", "R$ -0,25", "R$ 0,00", "R$ 2,67", "R$ 0,05"]
    assert [x.p for x in r] == ["1234,5%", "-0,2%", "—", "2,7%", "0,1%"]
    assert [x.d for x in r] == ["R$ 1.234,50", "R$ -0,25", "—", "R$ 2,67", "R$ 0,05"]
    assert [x.s for x in r] == ["positive", "negative", "neutral", "positive", "positive"]


def test_standard_names():
    assert standard_names(["Código da Nação", "  Nome (País) ", "Região Nº", "NOME-PAÍS", "***"]) == [
        "codigo_da_nacao", "nome_pais", "regiao_no", "nome_pais_2", "column_5"]


@pytest.mark.parametrize("values,expected", [
    ([], "Todas"), (["a"], "a"), (["a", "b", "c"], "a, b, c"), (["a", "b", "c", "d"], "4 selecionados")])
def test_list_summary(spark, values, expected):
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(T.list_summary(F.col("v"), "Todas")).first()[0] == expected


def test_with_date_matches_column_form(spark):
    values = ["2026-01-05", "05/01/2026", "01/13/2026", "5.1.2026", "05-01-2026", "20260105", "05/01/26",
              "2026/01/05", "2026-01-05 10:00:00", "31/02/2026", "hoje", None, " 07/03/2026 "]
    df = spark.createDataFrame([(v,) for v in values], "data string")
    staged = [r[0] for r in P.with_date(df, "data").collect()]
    assert staged == one_col(spark, values, P.parse_date)
