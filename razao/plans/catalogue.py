"""The query catalogue: one entry per operator family of the survey.

Every query takes ``(spark, sf_dir)``, builds its stand-in sheets from the
test tables (``sources.bindings``), runs them through the library and
returns a DataFrame. Names and column names match ``plans.oracle_queries``.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .. import schema as S
from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..functions.nulls import col_or
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import filters as FL
from ..operators import terms as TM
from ..session import app_id, ensure_checkpoint_dir
from ..sources import bindings as B
from ..sources import ingest, parts
from . import audit, marts, quality

RULES = R.DEFAULT_RULES
KEY = "codigo"
SELECTED_PERIODS = ("2024-03", "2025-12", "2026-08")


# ------------------------------------------------------------------ inputs

_PLANS: dict = {}
_LOCK = threading.RLock()
MATERIALIZE = os.environ.get("RAZAO_MATERIALIZE", "1") != "0"


def _plan(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """What ``build(slug)`` gives, once per session and folder; the slug stands for both in the checkpoint folder."""
    key = (app_id(spark), sf, name)
    with _LOCK:
        if key not in _PLANS:
            _PLANS[key] = build(f"{hashlib.sha1(sf.encode()).hexdigest()[:12]}/{name}")
        return _PLANS[key]


def checks(spark: SparkSession, sf: str) -> dict[str, dict[str, int]]:
    """The counts observed while the inputs were written, by table."""
    return _plan(spark, sf, "checks", lambda slug: {})


def _sheet(spark: SparkSession, sf: str, name: str, table: str, raw) -> DataFrame:
    """A standardized input, written once to the shared checkpoint folder and read back, so queries that use
    the ledger several times scan clean Parquet instead of re-parsing text in every branch. The test tables
    are single row groups, which one task reads alone. Rows are written as they come: a sort within tasks would hold a
    whole input split of wide rows in memory. With ``RAZAO_MATERIALIZE=0`` only the lazy plan is kept."""
    if not MATERIALIZE:
        return _plan(spark, sf, name, lambda slug: ingest.standardize(raw(), table, RULES))
    counts = checks(spark, sf).setdefault(table, {})
    return _plan(spark, sf, name, lambda slug: ingest.ingest_table(raw(), table, slug, RULES, unsplit=True,
                                                                   checks=quality.row_checks, into=counts))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, "ledger", R.LEDGER_TABLE, lambda: B.ledger_sheet(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, "items", "fact_marta", lambda: B.items_sheet(spark, sf, "Item"))


def rent(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, "rent", "fact_aluguel", lambda: B.items_sheet(spark, sf, "Rubrica"))


def revenue(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, "revenue", "dim_meses", lambda: B.revenue_sheet(spark, sf))


def betting(spark: SparkSession, sf: str) -> DataFrame:
    return _sheet(spark, sf, "betting", "fact_apostas_kto", lambda: B.betting_sheet(spark, sf))


def category_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The (period, category) sums that all category metrics read, computed once."""
    def build(slug):
        sums = marts.category_period_sums(ledger(spark, sf), None, RULES)
        return ingest.materialize(sums, slug, cluster_by=S.PERIOD) if MATERIALIZE else sums
    return _plan(spark, sf, "category_sums", build)


def workbook(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def build(slug):
        raw = B.workbook(spark, sf)
        out = {}
        for name, df in raw.items():
            known = {"fact_transacoes": ledger, "dim_meses": revenue, "fact_marta": items,
                     "fact_aluguel": rent, "fact_apostas_kto": betting}.get(name)
            out[name] = known(spark, sf) if known else ingest.standardize(df, name, RULES)
        return out
    return _plan(spark, sf, "workbook", build)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn(KEY, F.col(KEY).cast("long"))


def _amount(name: str = "amount"):
    return F.col(RULES.roles.amount).cast("double").alias(name)


# ------------------------------------------------------------------ sources

MESSY_NATION_HEADERS = ("Código da Nação", "  Nome (País) ", "Região Nº", "NOME-PAÍS")


def q_header_standardize(spark, sf):
    n = B.table(spark, sf, "nation")
    raw = n.select(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey"), F.col("n_name").alias("dup"))
    return ingest.standardize_headers(raw.toDF(*MESSY_NATION_HEADERS))


def q_drop_blank_rows(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey")
    blank = lambda v: (F.when(k % 34 == 0, F.lit("")).when(k % 17 == 0, F.lit(None))
                       .when(k % 23 == 0, F.lit("   ")).otherwise(v))
    raw = c.select(blank(k.cast("string")).alias("Código"), blank(F.col("c_name")).alias("Nome"),
                   blank(F.col("c_mktsegment")).alias("Segmento"))
    out = ingest.drop_blank_rows(ingest.standardize_headers(raw))
    return out.select(F.col("codigo").cast("long").alias("codigo"), "nome", "segmento")


def q_alias_and_provenance(spark, sf):
    raw = B.ledger_sheet(spark, sf).withColumnsRenamed({"Origem": "Fonte", "Descrição": "Nome Custo"})
    df = ingest.standardize(raw, R.LEDGER_TABLE, RULES)
    return _key(df).select(KEY, "origem", "descricao", S.SOURCE_TABLE)


def q_type_repair(spark, sf):
    df = ledger(spark, sf)
    return _key(df).select(KEY, F.col("data").alias("date"), _amount("amount"),
                           F.col("valor_euro_dashboard").cast("double").alias("amount_alt"), S.PERIOD)


def q_resolve_columns(spark, sf):
    parts = []
    for name, df in (("fact_marta", items(spark, sf)), ("fact_aluguel", rent(spark, sf))):
        v = S.value_column(df, RULES.roles.amount, RULES.roles.value_terms)
        i = S.item_column(df, "item", RULES.roles.item_candidates)
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(v)).cast("double").alias("value_total"),
                            F.count_distinct(F.col(i)).alias("distinct_items"))
                     .select(F.lit(name).alias("table_name"), F.lit(v).alias("value_column"),
                             F.lit(i).alias("item_column"), "row_count", "value_total", "distinct_items"))
    rev = revenue(spark, sf)
    rc = S.revenue_column(rev)
    parts.append(rev.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(rc)).cast("double").alias("value_total"))
                 .select(F.lit("dim_meses").alias("table_name"), F.lit(rc).alias("value_column"),
                         F.lit(None).cast("string").alias("item_column"), "row_count", "value_total",
                         F.lit(0).cast("long").alias("distinct_items")))
    missing = S.empty_frame(spark, "table_name string, value_column string, item_column string, "
                                   "row_count long, value_total double, distinct_items long")
    return A.union_all(*parts, missing)


def q_csv_round_trip(spark, sf):
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/razao-sink-{uuid.uuid4().hex}"
    k, name = F.col("s_suppkey"), F.col("s_name")
    note = (F.when(k % 8 == 0, F.concat(F.lit('he said "hi", '), name)).when(k % 8 == 1, F.concat(F.lit("  "), name, F.lit(" ")))
            .when(k % 8 == 2, F.concat(name, F.lit("\nsecond line"))).when(k % 8 == 3, F.concat(F.lit('"'), name, F.lit('",\n"a","b"')))
            .when(k % 8 == 4, F.lit("")).when(k % 8 == 5, F.lit(None)).when(k % 8 == 6, F.concat(name, F.lit("\\"))).otherwise(name))
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", note.alias("note"))
    ingest.write_csv(s.toDF("Código Fornecedor", "Nome", "Nação", "Saldo", "Nota"), path)
    back = ingest.standardize_headers(ingest.read_table(spark, path, "", "csv", multi_line=True))
    return back.select(F.col("codigo_fornecedor").cast("long").alias("s_suppkey"), F.col("nome").alias("s_name"),
                       F.col("nacao").cast("int").alias("s_nationkey"), F.col("saldo").cast("double").alias("s_acctbal"),
                       F.col("nota").alias("note"))


PART_ROWS = 500


def q_csv_parts(spark, sf):
    """An export in parts of three layouts, some rows with a cell too many or too few (SRC-1)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/razao-parts-{uuid.uuid4().hex}"
    k, name, cents = F.col("c_custkey"), F.col("c_name"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    part = F.floor(k / PART_ROWS)
    layouts = (("Código,Nome (Cliente),Saldo", (k, name, cents)), ("SALDO,código,nome cliente", (cents, k, name)), ("Nome Cliente,Código", (name, k)))
    lines, headers = F.lit(None), F.lit(None)
    for i, (header, cells) in enumerate(layouts):
        whole, cut = F.concat_ws(",", *cells), F.concat_ws(",", *cells[:-1])
        record = F.when(k % 50 == 0, F.concat(whole, F.lit(",extra"))).when(k % 50 == 1, cut).otherwise(whole)
        lines, headers = (F.when(part % 3 == i, x).otherwise(y) for x, y in ((record, lines), (F.lit(header), headers)))
    rows = B.table(spark, sf, "customer").select(part.alias("part"), k.alias("k"), lines.alias("line"), headers.alias("header"))
    file = F.concat(F.first("header"), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n"))
    rows.groupBy("part").agg(file.alias("file")).write.partitionBy("part").text(path)  # PART_ROWS rows a part at most
    read = parts.read_parts(spark, path)
    sound = read.rows.select(F.col("codigo").cast("long").alias("c_custkey"), F.col("nome_cliente").alias("c_name"), F.col("saldo").cast("long").alias("cents"))
    return A.union_all(sound, read.quarantine.select("expected_cells", "record"))


# ------------------------------------------------------------------ scalar functions

# Characters that decompose into several letters or lie beyond the first plane.
ODD_TEXT = " \u2122 \u2116 \u33a1 \u2153 \U0001d400\U0001d44f \uac01"


def q_text_normalize(spark, sf):
    d = B.table(spark, sf, "documents")
    odd = F.when(F.col("doc_id") % 7 == 0, F.lit(ODD_TEXT)).otherwise(F.lit(""))
    return d.select("doc_id", F.concat("text", odd).alias("text")).select("doc_id", T.normalize("text").alias("text_norm"))


def q_text_tools(spark, sf):
    c = B.table(spark, sf, "conversations")
    staged = c.withColumn("__n", T.normalize("text"))
    return staged.select(
        "conv_id", "turn",
        T.truncate(F.col("text"), 32).alias("preview"),
        F.coalesce(T.full_match(F.col("role"), ["user", "assistant"]), F.lit(False)).alias("is_dialog_role"),
        F.coalesce(T.contains_any(F.col("__n"), ["pour", "avec"]), F.lit(False)).alias("mentions_terms"),
        F.length(T.concat_text(F.col("role"), F.lit(None), F.col("text"))).alias("joined_length"),
        F.coalesce(col_or(c, "lang"), F.lit("n/a")).alias("lang_or_default"))


def q_list_summary(spark, sf):
    df = ledger(spark, sf).where(F.col(S.PERIOD).isNotNull())
    periods = df.select(S.PERIOD).distinct()
    acc = A.smallest_values(df, S.PERIOD, "origem", 3)
    cat = A.smallest_values(df, S.PERIOD, "categoria_dashboard", 3)
    g = (periods.join(acc.select(S.PERIOD, F.col("values").alias("a"), F.col("distinct_count").alias("na")),
                      S.PERIOD, "left")
         .join(cat.select(S.PERIOD, F.col("values").alias("c"), F.col("distinct_count").alias("nc")),
               S.PERIOD, "left"))
    empty = F.array().cast("array<string>")
    return g.select(S.PERIOD,
                    T.list_summary(F.coalesce(F.col("a"), empty), "Todas as origens",
                                   count=F.coalesce(F.col("na"), F.lit(0))).alias("accounts_summary"),
                    T.list_summary(F.coalesce(F.col("c"), empty), "Todas as categorias",
                                   count=F.coalesce(F.col("nc"), F.lit(0))).alias("categories_summary"))


def q_range_summary(spark, sf):
    """The months of each account as a list or, beyond three, as first and last."""
    df = ledger(spark, sf)
    by = df.where(F.col(S.PERIOD).isNotNull() & F.col("origem").isNotNull()).groupBy("origem").agg(F.sort_array(F.collect_set(S.PERIOD)).alias("p"))
    return by.select("origem", T.list_summary(F.col("p"), "Todos os meses", range_form=True).alias("months_summary"))


def q_number_parse(spark, sf):
    df = ledger(spark, sf)
    v = F.col(RULES.roles.amount)
    return _key(df).select(KEY, v.cast("double").alias("amount"), (v < 0).alias("is_negative"))


def q_number_parse_wide(spark, sf):
    """Amounts beyond 10^14 and with six decimals, as text."""
    k = F.col("o_orderkey")
    big = F.concat(F.lit("R$ "), F.translate(F.format_number(k * 1_000_000_000, 0), ",", "."), F.lit(".000,25"))
    small = F.concat(F.lit("0,"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    raw = B.table(spark, sf, "orders").select(k.alias("codigo"), F.when(k % 2 == 0, big).otherwise(small).alias("valor"))
    out = N.with_numbers(raw, ["valor"], RULES.money_type)
    return out.select("codigo", F.col("valor").cast("double").alias("amount"),
                      (F.col("valor") * 1_000_000).cast("decimal(38,0)").cast("string").alias("millionths"))


def q_money_format(spark, sf):
    o = B.table(spark, sf, "orders")
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    return o.select(k.alias("o_orderkey"),
                    N.format_money(x).alias("money_text"),
                    N.format_money(x / 6, "€").alias("money_alt_text"),
                    N.format_pct(x / 5000.0).alias("pct_text"),
                    N.format_count(k * 1000).alias("count_text"),
                    N.money_or_dash(F.when(k % 5 == 0, F.lit(0.0)).otherwise(x)).alias("dash_text"))


def q_number_signs(spark, sf):
    c = B.table(spark, sf, "customer")
    x = F.col("c_acctbal")
    return c.select("c_custkey", N.sign_class(x).alias("tone"), F.abs(x).alias("abs_value"), (-x).alias("negated"),
                    N.guarded_pct(x, F.col("c_nationkey")).alias("ratio_pct"))


def q_date_parse(spark, sf):
    df = ledger(spark, sf)
    return _key(df).select(KEY, F.col("data").alias("date"), P.format_date(F.col("data")).alias("date_text"))


def q_month_parse(spark, sf):
    df = ledger(spark, sf)
    return _key(df).select(KEY, S.PERIOD, S.PERIOD_LABEL)


# ------------------------------------------------------------------ flags and filters

def q_period_by_parts(spark, sf):
    """PRJ-1 from year and month numbers, and from a date alone."""
    o = B.table(spark, sf, "orders")
    d = F.add_months(F.to_date("o_orderdate"), B.YEAR_SHIFT_MONTHS)
    k = F.col("o_orderkey").cast("string")
    by_parts = ingest.standardize(o.select(k.alias("Código"), F.date_format(d, "yyyy").alias("Ano"), F.date_format(d, "M").alias("Mês Num")), "fact_parts", RULES)
    by_date = ingest.standardize(o.select(k.alias("Código"), F.date_format(d, "dd/MM/yyyy").alias("Data")), "fact_dates", RULES)
    parts = [_key(x).select(KEY, S.SOURCE_TABLE, S.PERIOD, S.PERIOD_LABEL) for x in (by_parts, by_date)]
    return A.union_all(*parts)


def q_clean_layout(spark, sf):
    """The period layout, written and read with a period filter (partition pruning)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/razao-layout-{uuid.uuid4().hex}"
    ingest.write_clean(ledger(spark, sf), path)
    df = FL.period_filter(spark.read.parquet(path), SELECTED_PERIODS)
    return df.groupBy(S.PERIOD).agg(F.count(F.lit(1)).alias("row_count"), F.sum(RULES.roles.amount).cast("double").alias("total"))


# ------------------------------------------------------------------ flags and filters (continued)

def q_total_line_flag(spark, sf):
    return _key(ledger(spark, sf)).select(KEY, S.IS_TOTAL)


def q_transaction_flags(spark, sf):
    return _key(ledger(spark, sf)).select(KEY, S.IS_PAYOUT, S.IS_STAKE, S.IS_SETTLEMENT, S.INCLUDE, S.IS_PERSONAL)


def q_exclusion_reason(spark, sf):
    return _key(ledger(spark, sf)).select(KEY, S.REASON)


def q_period_filter(spark, sf):
    df = FL.period_filter(ledger(spark, sf), SELECTED_PERIODS)
    return _key(df).select(KEY, S.PERIOD, _amount())


def q_period_date_range(spark, sf):
    """FLT-2 where the period came from the date: a pushed range of dates beside the periods."""
    o = B.table(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("Código"), F.date_format(B._shifted(F.col("o_orderdate")), "dd/MM/yyyy").alias("Data"))
    by_date = _plan(spark, sf, "by_date", lambda slug: ingest.materialize(ingest.standardize(raw, "fact_dates", RULES), slug, cluster_by="data"))
    return _key(FL.period_filter(by_date, SELECTED_PERIODS, RULES)).select(KEY, S.PERIOD, F.col("data").alias("date"))


FACET_ACCOUNTS = ("Conta Corrente",)
FACET_CATEGORIES = ("Mercado", "Lazer")
FACET_PERIODS = tuple(f"2025-{m:02d}" for m in range(1, 13))


def q_facet_filter(spark, sf):
    df = FL.facet_filter(ledger(spark, sf), FACET_PERIODS, FACET_ACCOUNTS, FACET_CATEGORIES, RULES)
    return _key(df).select(KEY, S.PERIOD, "origem", "categoria_dashboard")


def q_facet_table(spark, sf):
    """Selections held in tables: a semi join on the account, an anti join on the category."""
    df = ledger(spark, sf)
    accounts = df.where(F.col("origem") != "Poupança").select("origem")
    hidden = df.where(F.col("categoria_dashboard").isin("Bet", "Bet retorno")).select("categoria_dashboard")
    out = FL.anti_join_values(FL.semi_join_values(df, "origem", accounts), "categoria_dashboard", hidden)
    return _key(out).select(KEY, "origem", "categoria_dashboard")


def q_facet_values(spark, sf):
    df = ledger(spark, sf)
    parts = [FL.facet_values(df, c).select(F.lit(c).alias("facet"), F.col(c).alias("value"))
             for c in (S.PERIOD, "origem", "categoria_dashboard")]
    return A.union_all(*parts)


def q_personal_costs(spark, sf):
    return _key(C.personal_costs(ledger(spark, sf))).select(KEY, S.PERIOD, _amount())


def q_excluded_rows(spark, sf):
    return _key(C.excluded_rows(ledger(spark, sf))).select(KEY, S.REASON, _amount())


def q_non_bet_rows(spark, sf):
    return _key(C.non_bet_rows(ledger(spark, sf), RULES)).select(KEY, "categoria_dashboard")


def q_accrual_costs(spark, sf):
    return _key(C.accrual_costs(ledger(spark, sf), RULES)).select(KEY, S.PERIOD, _amount("cost"))


def q_cash_costs(spark, sf):
    return _key(C.cash_costs(ledger(spark, sf), RULES)).select(KEY, S.PERIOD, _amount("cost"))


SEARCH_TERM = "Condomínio"


def q_description_search(spark, sf):
    df = FL.description_search(ledger(spark, sf), SEARCH_TERM, "literal", RULES)
    return _key(df).select(KEY, "descricao")


DOC_TERM = "Été"


def q_document_search(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("text").alias("descricao"))
    return FL.description_search(d, DOC_TERM, "regex", RULES).select("doc_id")


def q_term_table_search(spark, sf):
    """Thousands of terms in a table (the longer words of the conversations), searched in whole documents."""
    words = B.table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("term")).where(F.char_length("term") >= 7)
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    return TM.add_match_counts(docs, "text", words, "n_terms", gram=6).select("doc_id", "n_terms")


def q_shared_home_table(spark, sf):
    """FLT-9 with its names in a table."""
    names = spark.createDataFrame([(n,) for n in T.normalize_terms(RULES.shared_home_names)], "term string")
    df = TM.add_listed_flag(_key(ledger(spark, sf)), ["descricao_norm"], names, "listed")
    return df.select(KEY, (F.col("listed") & (F.col("categoria_dashboard_norm") == "custo de casa")).alias("shared_home"))


def q_receivable_term_table(spark, sf):
    """FLT-14 with its terms in a table."""
    terms = spark.createDataFrame([(n,) for n in T.normalize_terms(RULES.receivable_terms)], "term string")
    kept = FL.receivable_items(items(spark, sf), "item", RULES, terms)
    return kept.groupBy(S.PERIOD, "item", "is_rebate").agg(F.count(F.lit(1)).alias("row_count"))


BILL_TERMS = (("luz", "Luz", 1), ("gas", "Gás", 2), ("celular", "Celular", 3), ("telemovel", "Celular", 3), ("internet", "Internet + TV", 4), ("tv", "Internet + TV", 4))


def q_bill_term_table(spark, sf):
    """FLT-15 with its terms in a table, the last class winning."""
    terms = spark.createDataFrame(BILL_TERMS, "term string, label string, place int")
    out = TM.add_term_class(items(spark, sf), "item_norm", terms, "bill")
    return out.groupBy("item", "bill").agg(F.count(F.lit(1)).alias("row_count"))


def q_technical_exclusion(spark, sf):
    return _key(FL.exclude_technical(ledger(spark, sf), RULES)).select(KEY, "categoria_dashboard")


def q_technical_fallback(spark, sf):
    only_technical = ledger(spark, sf).where(F.col("categoria_dashboard") == "Ajuste/abatimento")
    return _key(FL.exclude_technical(only_technical, RULES)).select(KEY, "categoria_dashboard")


# ------------------------------------------------------------------ aggregates

def q_card_statement(spark, sf):
    out = A.card_statement(ledger(spark, sf), RULES)
    return out.select(S.PERIOD, S.PERIOD_LABEL, F.col("categoria_dashboard").alias("category"), _amount("value"))


def q_monthly_sum(spark, sf):
    out = A.monthly_sum(C.cash_costs(ledger(spark, sf), RULES), RULES.roles.amount, "value")
    return out.select(S.PERIOD, S.PERIOD_LABEL, F.col("value").cast("double").alias("value"))


def q_total_sum(spark, sf):
    return A.total_sum(ledger(spark, sf), RULES.roles.amount).select(F.col("total").cast("double").alias("total"))


# ------------------------------------------------------------------ marts

def q_cash_flow_overview(spark, sf):
    return marts.cash_flow_monthly(ledger(spark, sf), revenue(spark, sf), None, RULES)


def q_cash_flow_month(spark, sf):
    return marts.cash_flow_summary(ledger(spark, sf), revenue(spark, sf), ["2026-03"], RULES)


REVENUE_ONLY_PERIODS = ("2026-03", "2026-08", "2026-10")


def q_cash_flow_selection(spark, sf):
    """Several months, one of which has revenue and no cash row."""
    return marts.cash_flow_summary(ledger(spark, sf), revenue(spark, sf), REVENUE_ONLY_PERIODS, RULES)


def q_cash_flow_last_month(spark, sf):
    """No selection: the last month with cash rows."""
    return marts.cash_flow_summary(ledger(spark, sf), revenue(spark, sf), None, RULES)


TOP_CATEGORIES = 2


def q_category_top_others(spark, sf):
    return marts.cash_by_category(ledger(spark, sf), None, TOP_CATEGORIES, RULES)


def q_source_composition(spark, sf):
    return marts.cash_by_source(ledger(spark, sf), None, RULES)


def q_transaction_listing(spark, sf):
    rows = marts.transaction_rows(ledger(spark, sf), "condominio", "literal", personal_only=True, rules=RULES)
    return marts.transaction_listing(rows, audit=True, presentation=True, rules=RULES)


def q_transaction_metrics(spark, sf):
    rows = marts.transaction_rows(_key(ledger(spark, sf)), rules=RULES)
    return marts.transaction_metrics(rows, RULES, order_col=KEY)


def q_category_ranking(spark, sf):
    return marts.category_ranking(None, None, False, RULES, category_sums(spark, sf))


def q_category_headline(spark, sf):
    return marts.category_headline(None, revenue(spark, sf), None, 3, RULES, category_sums(spark, sf))


EVOLUTION_CATEGORIES = ("Mercado", "Lazer", "Cartão de Crédito")


def q_category_evolution(spark, sf):
    return marts.category_evolution(None, revenue(spark, sf), EVOLUTION_CATEGORIES, None, True, RULES, category_sums(spark, sf))


def q_category_compared(spark, sf):
    """No choice of categories: the five largest, with the monthly revenue."""
    return marts.category_evolution(None, revenue(spark, sf), None, None, True, RULES, category_sums(spark, sf))


def q_category_means(spark, sf):
    return marts.category_means(q_category_evolution(spark, sf))


def q_evolution_extent(spark, sf):
    evo = marts.category_evolution(None, revenue(spark, sf), EVOLUTION_CATEGORIES, None, False, RULES, category_sums(spark, sf))
    per = evo.groupBy(S.PERIOD).pivot("category", list(EVOLUTION_CATEGORIES)).agg(F.sum("value")).fillna(0.0)
    return A.extent(per, list(EVOLUTION_CATEGORIES))


def q_source_spend(spark, sf):
    return marts.source_spend(ledger(spark, sf), None, RULES)


def q_category_revenue(spark, sf):
    return marts.category_revenue_table(None, revenue(spark, sf), None, False, RULES, category_sums(spark, sf))


def q_receivable_statement(spark, sf):
    return marts.receivable_statement(items(spark, sf), RULES)


def q_receivable_view(spark, sf):
    return marts.receivable_view(items(spark, sf), RULES)


def q_receivable_change(spark, sf):
    return marts.receivable_totals(items(spark, sf), RULES)


def q_receivable_summary(spark, sf):
    return marts.receivable_summary(items(spark, sf), RULES)


def q_receivable_months(spark, sf):
    return A.distinct_pairs(items(spark, sf), S.PERIOD, S.PERIOD_LABEL)


def q_receivable_detail(spark, sf):
    return marts.receivable_detail(items(spark, sf), RULES)


def q_house_costs(spark, sf):
    out = marts.house_costs(rent(spark, sf), ledger(spark, sf), RULES)
    return out.select(S.PERIOD, S.PERIOD_LABEL, "rubrica", F.col("valor_real_dashboard").cast("double").alias("value"),
                      "fonte_dado")


def q_item_summary(spark, sf):
    house = marts.house_costs(rent(spark, sf), ledger(spark, sf), RULES)
    return marts.item_summary(house, items(spark, sf), "rubrica", RULES)


def q_item_detail(spark, sf):
    house = marts.house_costs(rent(spark, sf), ledger(spark, sf), RULES)
    return marts.item_detail(house, "rubrica", True, RULES)


def q_utility_monthly(spark, sf):
    return marts.utility_monthly(items(spark, sf), RULES)


def q_bet_ledger(spark, sf):
    return marts.bet_ledger(ledger(spark, sf), betting(spark, sf), S.PERIOD, RULES)


def _by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format(F.col("data"), "yyyy-MM-dd"))


def q_bet_ledger_fallback(spark, sf):
    no_bets = _by_day(C.non_bet_rows(ledger(spark, sf), RULES))
    return marts.bet_ledger(no_bets, _by_day(betting(spark, sf)), "day", RULES)


def q_bet_ledger_exclusive(spark, sf):
    rules = R.LedgerRules(exclusive_bet_fallback=True)
    no_bets = _by_day(C.non_bet_rows(ledger(spark, sf), rules))
    return marts.bet_ledger(no_bets, _by_day(betting(spark, sf)), "day", rules)


def q_bet_detail(spark, sf):
    return marts.bet_detail(ledger(spark, sf), RULES)


def q_bet_running_rows(spark, sf):
    """WIN-4 and WIN-1 at row grain: the balance after every betting row, and the row before."""
    df = _key(ledger(spark, sf)).where((F.col(S.IS_STAKE) | F.col(S.IS_PAYOUT)) & ~F.col(S.IS_TOTAL))
    amount = F.col(RULES.roles.amount)
    rows = df.select(KEY, F.col("data").alias("date"), F.when(F.col(S.IS_PAYOUT), amount).otherwise(-amount).alias("value"))
    out = A.running_rows(rows, "value", ("date", KEY))
    return out.select(KEY, "date", *[F.col(c).cast("double").alias(c) for c in ("value", "running", "previous")])


def q_month_merge(spark, sf):
    """JON-1 over three tables of their own: revenue, cash costs and stakes by month."""
    stakes = betting(spark, sf).where(F.col("tipo_norm") == "bet")
    out = A.merge_by_key({"revenue": (revenue(spark, sf), "receita_salario"), "cash": (C.cash_costs(ledger(spark, sf), RULES), RULES.roles.amount),
                          "staked": (stakes, RULES.roles.amount)})
    return out.select(S.PERIOD, *[F.col(c).cast("double").alias(c) for c in ("revenue", "cash", "staked")])


def q_distinct_estimate(spark, sf):
    """AGG-9 from sketches by month, merged for the whole: within 2 % of the exact count."""
    df = ledger(spark, sf)
    sketches = A.distinct_sketches(df, S.PERIOD, "descricao")
    rows = df.where(F.col(S.PERIOD).isNotNull())
    parts = []
    for keys, name in (([S.PERIOD], F.col(S.PERIOD)), ([], F.lit("all"))):
        exact, about = rows.groupBy(*keys).agg(F.count_distinct("descricao").alias("exact")), A.distinct_estimate(sketches, keys)
        both = exact.join(about, keys) if keys else exact.crossJoin(about)  # one row each
        parts.append(both.select(name.alias("scope"), F.col("exact").alias("distinct_items"),
                                 (F.abs(F.col("distinct_items") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_two_percent")))
    return A.union_all(*parts)


# ------------------------------------------------------------------ audit and quality

def q_audit_summary(spark, sf):
    return audit.audit_summary(ledger(spark, sf), RULES)


def q_audit_counts(spark, sf):
    return audit.audit_counts(ledger(spark, sf), RULES)


def q_audit_exclusions(spark, sf):
    return audit.audit_exclusions(ledger(spark, sf), RULES)


def q_audit_months(spark, sf):
    return audit.audit_months(ledger(spark, sf), RULES)


def q_audit_categories(spark, sf):
    return audit.audit_categories(ledger(spark, sf), RULES)


def q_audit_sources(spark, sf):
    return audit.audit_sources(ledger(spark, sf), RULES)


def q_audit_pack(spark, sf):
    """All aggregated tables of the pack from one scan."""
    cube = audit.audit_cube(ledger(spark, sf), RULES)
    return cube.select("section", "key", *[F.col(m).cast("double").alias(m) if m in ("gross", "kept", "staked", "returned") else F.col(m)
                                           for m in audit.MEASURES])


def q_audit_sample_included(spark, sf):
    s = audit.audit_samples(_key(ledger(spark, sf)), order_cols=(KEY,))["included"]
    return s.withColumn(RULES.roles.amount, F.col(RULES.roles.amount).cast("double"))


def q_audit_sample_excluded(spark, sf):
    s = audit.audit_samples(_key(ledger(spark, sf)), order_cols=(KEY,))["excluded"]
    return s.withColumn(RULES.roles.amount, F.col(RULES.roles.amount).cast("double"))


def _known(spark, sf):
    return {name: counts for name, counts in checks(spark, sf).items() if counts}


def q_quality_report(spark, sf):
    book = workbook(spark, sf)
    return quality.quality_issues(spark, book, R.TABLE_NAMES, RULES, _known(spark, sf))


def q_quality_scan(spark, sf):
    """The same report where no counts are known: one aggregation for each table."""
    return quality.quality_issues(spark, workbook(spark, sf), R.TABLE_NAMES, RULES)


def q_table_inventory(spark, sf):
    book = workbook(spark, sf)
    return quality.table_inventory(spark, book, R.TABLE_NAMES, _known(spark, sf))


def q_quality_incomplete(spark, sf):
    """A workbook without one table and without two columns of another (DQ-1, DQ-2)."""
    book = {n: d for n, d in workbook(spark, sf).items() if n != "fact_balanco_mensal"}
    book["fact_transacoes"] = book["fact_transacoes"].drop("parcela_compra", "valor_euro_dashboard")
    return quality.quality_issues(spark, book, R.TABLE_NAMES, RULES)


def q_quality_status(spark, sf):
    """The overall status (DQ-8) of the whole workbook and of one sound table."""
    whole = quality.quality_status(quality.quality_issues(spark, workbook(spark, sf), R.TABLE_NAMES, RULES))
    sound = quality.quality_status(quality.quality_issues(spark, workbook(spark, sf), ("dim_meses",), RULES))
    return A.union_all(whole.withColumn("scope", F.lit("workbook")), sound.withColumn("scope", F.lit("dim_meses")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
