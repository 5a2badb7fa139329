from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from razao.session import local_session
    s = local_session("*", shuffle_partitions=8, app="razao-tests")
    yield s
    s.stop()


# The demo workbook of FIXTURES.md section 2: every cell is text, headers as a
# spreadsheet export would carry them.
LEDGER_HEADERS = ["Mês", "Data", "Descrição", "Origem", "Categoria Dashboard", "Categoria Original Excel",
                  "Valor Real Dashboard", "Valor Euro Dashboard", "Entra Custo Pessoal", "Parcela Compra"]
LEDGER_ROWS = [
    ("Janeiro", "05/01/2026", "Supermercado Continente", "Conta Corrente", "Mercado", "Supermercado", "850,00", "145,00", "Sim", "1 de 1"),
    ("Janeiro", "11/01/2026", "Restaurante fim de semana", "Cartão de Crédito", "Lazer", "Restaurantes", "320,00", "55,00", "Sim", "1 de 1"),
    ("Janeiro", "18/01/2026", "Pagamento de fatura cartão", "Conta Corrente", "Cartão de Crédito", "Fatura", "1170,00", "200,00", "Sim", "1 de 1"),
    ("Fevereiro", "04/02/2026", "Farmácia", "Conta Corrente", "Saúde", "Farmácia", "210,00", "36,00", "Sim", "1 de 1"),
    ("Fevereiro", "09/02/2026", "Curso Python parcelado", "Cartão de Crédito", "Educação", "Cursos", "180,00", "31,00", "Sim", "1 de 3"),
    ("Fevereiro", "12/02/2026", "KTO aposta", "Cartão de Crédito", "Bet", "Apostas", "250,00", "43,00", "Sim", "1 de 1"),
    ("Fevereiro", "20/02/2026", "KTO levantamento", "Conta Corrente", "Bet retorno", "Apostas retorno", "140,00", "24,00", "Não", "1 de 1"),
    ("Março", "06/03/2026", "Mercado mensal", "Conta Corrente", "Mercado", "Supermercado", "920,00", "157,00", "Sim", "1 de 1"),
    ("Março", "14/03/2026", "Uber e transportes", "Cartão de Crédito", "Transporte", "Mobilidade", "260,00", "44,00", "Sim", "1 de 1"),
    ("Março", "31/03/2026", "Total março", "", "Total", "Total", "1180,00", "201,00", "Sim", "1 de 1"),
]
REVENUE_ROWS = [("Janeiro", "12000,00"), ("Fevereiro", "12000,00"), ("Março", "12500,00")]
CATEGORY_ROWS = [("Mercado", "Custo variável"), ("Lazer", "Custo variável"), ("Saúde", "Custo variável"),
                 ("Educação", "Investimento pessoal"), ("Transporte", "Custo variável"), ("Bet", "Apostas"),
                 ("Bet retorno", "Apostas")]
RECEIVABLE_ROWS = [
    ("Janeiro", "Aluguel", "2250,00"), ("Janeiro", "Condomínio", "360,00"), ("Janeiro", "IPTU", "90,00"),
    ("Janeiro", "Internet + TV", "120,00"), ("Janeiro", "Gympass", "180,00"),
    ("Fevereiro", "Aluguel", "2250,00"), ("Fevereiro", "Condomínio", "365,00"), ("Fevereiro", "Seguro telemóvel", "45,00"),
    ("Fevereiro", "Luz", "160,00"), ("Fevereiro", "Gás", "70,00"), ("Fevereiro", "Gympass", "180,00"),
    ("Março", "Aluguel", "2250,00"), ("Março", "Condomínio", "370,00"), ("Março", "IPTU", "90,00"),
    ("Março", "Internet + TV", "120,00"), ("Março", "Luz", "150,00"), ("Março", "Gás", "65,00"),
    ("Março", "Gympass", "180,00"), ("Março", "Total Marta", "2865,00"),
]
RENT_ROWS = [
    ("Janeiro", "Aluguel", "4500,00"), ("Janeiro", "Condomínio", "720,00"), ("Janeiro", "IPTU", "180,00"),
    ("Fevereiro", "Aluguel", "4500,00"), ("Fevereiro", "Condomínio", "730,00"), ("Fevereiro", "Seguro incêndio", "65,00"),
    ("Março", "Aluguel", "4500,00"), ("Março", "Condomínio", "740,00"), ("Março", "Custo total aluguel", "5240,00"),
]
BET_ROWS = [("Fevereiro", "bet", "KTO aposta", "250,00"), ("Fevereiro", "bet retorno", "KTO levantamento", "140,00"),
            ("Março", "bet", "KTO aposta", "100,00")]
BALANCE_ROWS = [("Janeiro", "12000,00", "6570,00"), ("Fevereiro", "12000,00", "5905,00"), ("Março", "12500,00", "6420,00")]
NOTES_ROWS = [("demo", "Dados simulados para pré-visualização local sem secrets.")]


def _text_frame(spark, headers, rows):
    schema = ", ".join(f"`c{i}` string" for i in range(len(headers)))
    return spark.createDataFrame(rows, schema).toDF(*headers)


@pytest.fixture(scope="session")
def demo_raw(spark):
    return {
        "fact_transacoes": _text_frame(spark, LEDGER_HEADERS, LEDGER_ROWS),
        "dim_meses": _text_frame(spark, ["Mês", "Receita Salário"], REVENUE_ROWS),
        "dim_categorias": _text_frame(spark, ["Categoria Dashboard", "Grupo"], CATEGORY_ROWS),
        "fact_marta": _text_frame(spark, ["Mês", "Item", "Valor Real Dashboard"], RECEIVABLE_ROWS),
        "fact_aluguel": _text_frame(spark, ["Mês", "Item", "Valor Real Dashboard"], RENT_ROWS),
        "fact_apostas_kto": _text_frame(spark, ["Mês", "Tipo", "Descrição", "Valor Real Dashboard"], BET_ROWS),
        "fact_balanco_mensal": _text_frame(spark, ["Mês", "Receita Líquida", "Custo Total"], BALANCE_ROWS),
        "README_modelo": _text_frame(spark, ["Seção", "Descrição"], NOTES_ROWS),
    }


@pytest.fixture(scope="session")
def demo(demo_raw):
    from razao.sources import ingest
    return {name: ingest.standardize(df, name) for name, df in demo_raw.items()}
