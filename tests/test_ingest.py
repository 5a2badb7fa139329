"""Reading and writing tables: odd cells, name clashes, missing columns, wrong paths."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from razao import schema as S
from razao.operators import filters as FL
from razao.plans import marts
from razao.rules import Roles
from razao.sources import ingest, parts


def test_csv_keeps_every_cell(spark, tmp_path):
    cells = ["  a ", 'he said "hi", ok', "line1\nline2", '"', '",\n"a","b"', "back\\slash", "", None, "plain", "\ttab"]
    df = spark.createDataFrame(list(enumerate(cells)), "n int, cell string")
    path = str(tmp_path / "table")
    ingest.write_csv(df, path)
    back = ingest.read_table(spark, path, "", "csv", multi_line=True)
    assert {int(r["n"]): r["cell"] for r in back.collect()} == {i: c or None for i, c in enumerate(cells)}
    with pytest.raises(AnalysisException):
        ingest.write_csv(df, path)


def test_standard_csv_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"he said ""hi"", ok",2\n', encoding="utf-8")
    assert tuple(ingest.read_table(spark, str(tmp_path), "t", "csv", ".csv").first()) == ('he said "hi", ok', "2")


def test_parts_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    part = lambda name, text: (tmp_path / "t" / name).write_text(text, encoding="utf-8")
    part("1.csv", 'Mês,Descrição,Valor\njaneiro,"a, ""b""",1\nfevereiro,c,2\n')
    part("2.csv", "\ufeffVALOR,mes,Descricao,Nota\n3,março,d,x\n4,abril,e\n")  # another order, one more column, a row with a cell too few
    part("3.csv", "Mês,Descrição,Valor\nmaio,f,5,zzz\njunho,,6\n,,\n")  # a cell too many, blank cells
    part("4.csv", "")
    part("5.csv", "Valor,Valor\n7,8\n")
    got = parts.read_parts(spark, str(tmp_path / "t"), part_column="file")
    assert got.rows.columns == ["mes", "descricao", "valor", "file", "nota", "valor_2"]
    rows = [(r.file.rsplit("/")[-1], r.mes, r.descricao, r.valor, r.nota, r.valor_2) for r in got.rows.collect()]
    assert sorted(rows, key=repr) == sorted([
        ("1.csv", "janeiro", 'a, "b"', "1", None, None), ("1.csv", "fevereiro", "c", "2", None, None), ("2.csv", "março", "d", "3", "x", None),
        ("3.csv", "junho", None, "6", None, None), ("3.csv", None, None, None, None, None), ("5.csv", None, None, "7", None, "8")], key=repr)
    bad = [(r.part.rsplit("/")[-1], r.expected_cells, r.record) for r in got.quarantine.collect()]
    assert sorted(bad) == [("2.csv", 4, "4,abril,e"), ("3.csv", 3, "maio,f,5,zzz")]
    # whatever a query reads, the same rows are sound
    assert got.rows.select("valor").count() == 6 == got.rows.count() and got.rows.where("valor = '5'").count() == 0
    assert ingest.read_table(spark, str(tmp_path), "t", "parts").count() == 6
    clean = ingest.read_workbook(spark, str(tmp_path), names=["t"], fmt="parts")["t"]
    assert sorted(r.period[-2:] for r in clean.where("period IS NOT NULL").collect()) == ["01", "02", "03", "06"]


def test_parts_with_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Nota\n(texto)",Valor\n"one\ntwo",1\n"three",2,3\n', encoding="utf-8")
    got = parts.read_parts(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert [tuple(r) for r in got.rows.collect()] == [("one\ntwo", "1")] and got.rows.columns == ["nota_texto", "valor"]
    assert [r.expected_cells for r in got.quarantine.collect()] == [2]


def test_parts_of_one_header_are_one_scan(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text("A,B\n1,2\n" if i % 2 else "B,A\n2,1\n")
    plan = parts.read_parts(spark, str(tmp_path)).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2
    assert parts.read_parts(spark, str(tmp_path)).rows.where("a = '1' AND b = '2'").count() == 6


@pytest.mark.parametrize("multi_line", [False, True])
def test_headers_of_many_parts_are_read_in_one_scan(spark, tmp_path, monkeypatch, multi_line):
    texts = ["A,B\n1,2\n", "B,A\n2,1\n", "\n\nA,B\n1,2\n", "", "\ufeffA,B\n1,2\n", "A\n1\n", "A,B,C\n1,2,3\n1,2\n", 'A,"B, b"\n1,2\n', "A,B\n", "B\n2\n"]
    texts += ['"A\nx",B\n1,2\n', '"A\ny",B\n1,2\n'] if multi_line else []
    for i in range(2 * len(texts)):
        (tmp_path / f"{i:02d}.csv").write_text(texts[i % len(texts)], encoding="utf-8")
    few = parts.read_parts(spark, str(tmp_path), multi_line, "file")
    asked = []
    monkeypatch.setattr(parts, "HEADER_JOBS", 1)
    monkeypatch.setattr(parts, "_header", lambda *a, f=parts._header: asked.append(a[1]) or f(*a))
    many = parts.read_parts(spark, str(tmp_path), multi_line, "file")
    in_order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert many.rows.columns == few.rows.columns and in_order(many.rows) == in_order(few.rows) and many.rows.count() >= 14
    assert in_order(many.quarantine) == in_order(few.quarantine) and many.quarantine.count() == 2
    assert len(asked) <= len(texts)  # a job for each different first record, not for each part


def test_skip_is_for_missing_tables_only(spark, tmp_path):
    assert ingest.read_workbook(spark, str(tmp_path), names=["none"], missing="skip") == {}
    (tmp_path / "broken").write_text("not parquet")
    with pytest.raises(Exception) as seen:
        ingest.read_workbook(spark, str(tmp_path), names=["broken"], fmt="parquet", missing="skip")
    assert not isinstance(seen.value, ingest.MissingTableError)


def test_input_column_named_period_stays(spark):
    df = spark.createDataFrame([("Janeiro 2026", "x")], "Mes string, Period string")
    out = ingest.standardize(df, "dim_meses")
    assert (out.first()["period"], out.first()["period_input"]) == ("2026-01", "x")


@pytest.mark.parametrize("name,money", [
    ("valor_real", True), ("receita_salario", True), ("custo_total", True), ("entra_custo_pessoal", False), ("nome_custo", False),
    ("categoria_valor", False), ("descricao", False), ("tipo_custo", False), ("saldo", True), ("item", False)])
def test_money_column_names(name, money):
    assert bool(Roles().number_name.match(name)) == money


def test_month_without_cash_rows_keeps_its_revenue(spark):
    ledger = ingest.standardize(spark.createDataFrame(
        [("01/2026", "Loja", "Conta", "Mercado", "100,00", "Sim")],
        "Mes string, Descricao string, Origem string, `Categoria Dashboard` string, `Valor Real Dashboard` string, `Entra Custo Pessoal` string"), "fact_transacoes")
    revenue = ingest.standardize(spark.createDataFrame([("01/2026", "500,00"), ("02/2026", "700,00")], "Mes string, `Receita Salario` string"), "dim_meses")
    both = marts.cash_flow_summary(ledger, revenue, ["2026-01", "2026-02"]).first()
    assert (both.revenue, both.cash_out, both.balance) == (1200.0, 100.0, 1100.0)
    assert marts.cash_flow_summary(ledger, revenue, ["2026-02"]).first().revenue == 700.0


def test_statement_keeps_equal_rows(spark):
    items = ingest.standardize(spark.createDataFrame([("01/2026", "Luz", "10,00")] * 2, "Mes string, Item string, `Valor Real Dashboard` string"), "fact_marta")
    rows = marts.receivable_statement(items).collect()
    assert [r.value for r in rows] == [10.0, 10.0, 20.0]


def test_marts_without_their_columns_are_empty(spark):
    bare = ingest.standardize(spark.createDataFrame([("01/2026", "x")], "Mes string, Nota string"), "fact_marta")
    assert marts.item_summary(bare, bare).count() == 0 and marts.item_detail(bare).count() == 0
    assert marts.bet_ledger(bare, bare).count() == 0 and marts.receivable_statement(bare).count() == 0


def test_period_filter_reads_the_period_alone(spark):
    df = spark.createDataFrame([("2026-01", None), ("2026-01", "2025-05-05"), ("2026-02", "2026-01-09")], f"{S.PERIOD} string, data string").withColumn("data", F.to_date("data"))
    assert FL.period_filter(df, ["2026-01"]).count() == 2
