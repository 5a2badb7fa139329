"""Stand-in ledger sheets built from the shared test tables.

Each builder only dresses rows of a test table as the dirty, all-text sheet
the ledger jobs expect (localized money text, mixed date and month shapes,
accented labels, messy headers). They do none of the jobs' work: parsing,
flagging and aggregating happen afterwards in the library, which knows
nothing of how these rows were made.

Mappings (key ``k`` = ``o_orderkey``; dates shifted by 25 years):

* ledger   ``orders`` join ``customer``: category by priority, account by status,
  description by key, include flag, money text ``R$ 1.234,56`` or ``(1.234,56)``
  or blank, date in nine shapes (ISO, day first, month first, with a time, with an
  English month word), month as Portuguese name, ``mm/yyyy``, ``yyyy-mm``,
  ``abr/yyyy``, a date with a time or a date in words;
* items    ``lineitem`` join ``part``: item by the last word of the part name;
* revenue  ``lineitem`` summed by ship month;
* betting  ``events`` purchase / signup / error as stake / payout / withdrawal, any
  other event type as its own type text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Portuguese month names used to write month text.
MONTH_NAMES_PT = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho",
                  "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
MONTH_ABBR_PT = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
MONTH_LABEL_PT = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
ITEM_BY_WORD = (
    ("anvil", "Aluguel"),
    ("bolt", "Luz"),
    ("gear", "Gás"),
    ("gizmo", "Internet + TV"),
    ("plate", "Gympass"),
    ("ring", "Seguro telemóvel"),
    ("rod", "Total contas"),
)
ITEM_DEFAULT = "Mercearia"
YEAR_SHIFT_MONTHS = 25 * 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(arr, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in arr]), idx)


def brl_text(x: Column) -> Column:
    """1234.5 -> '1.234,50'."""
    us = F.format_number(x, 2)
    return F.replace(F.replace(F.replace(us, F.lit(","), F.lit("_")), F.lit("."), F.lit(",")), F.lit("_"), F.lit("."))


def _shifted(ts: Column) -> Column:
    return F.add_months(F.to_date(ts), YEAR_SHIFT_MONTHS)


def ledger_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty transaction sheet (``fact_transacoes``) from orders and customers."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    pri = F.col("o_orderpriority")
    d = _shifted(F.col("o_orderdate"))
    yy, mm, dd = F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd")
    brl = brl_text(F.col("o_totalprice"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    eur_cents = F.floor(cents / 6).cast("long")
    eur = F.concat((eur_cents / 100).cast("long").cast("string"), F.lit(","),
                   F.lpad((eur_cents % 100).cast("string"), 2, "0"))
    category = (
        F.when(k % 211 == 0, F.lit(""))
        .when((pri == "1-URGENT") & (k % 10 == 7), F.lit("Bet retorno"))
        .when(pri == "1-URGENT", F.lit("Bet"))
        .when(pri == "2-HIGH", F.lit("Custo de casa"))
        .when(pri == "3-MEDIUM", F.lit("Mercado"))
        .when(pri == "4-NOT SPECIFIED", F.lit("Ajuste/abatimento"))
        .otherwise(F.lit("Lazer"))
    )
    account = (
        F.when(F.col("o_orderstatus") == "F", F.lit("Cartão de Crédito"))
        .when(F.col("o_orderstatus") == "O", F.lit("Conta Corrente"))
        .otherwise(F.lit("Poupança"))
    )
    description = (
        F.when(k % 97 == 0, F.lit("Total do mês"))
        .when(k % 13 == 0, F.lit("Pagamento de fatura"))
        .when(k % 5 == 0, F.lit("Luz"))
        .when(k % 5 == 1, F.lit("  Condomínio "))
        .otherwise(F.col("c_name"))
    )
    month_idx = F.month(d)
    day_first, in_words = F.concat_ws("/", dd, mm, yy), F.date_format(d, "MMMM d, yyyy")
    month_text = (
        F.when(k % 6 == 0, F.concat(_pick(MONTH_NAMES_PT, month_idx), F.lit(" "), yy))
        .when(k % 6 == 1, F.concat(mm, F.lit("/"), yy))
        .when(k % 6 == 2, F.concat(yy, F.lit("-"), mm))
        .when(k % 6 == 3, F.concat(_pick(MONTH_ABBR_PT, month_idx), F.lit("/"), yy))
        .when(k % 6 == 4, F.concat(day_first, F.lit(" 10:30")))
        .otherwise(in_words)
    )
    date_text = (
        F.when(k % 9 == 0, F.concat_ws("-", yy, mm, dd))
        .when((k % 9 == 1) & (dd.cast("int") > 12), F.concat_ws("/", mm, dd, yy))
        .when(k % 9 == 2, F.concat(day_first, F.lit(" 10:30")))
        .when(k % 9 == 3, F.date_format(d, "d MMM yyyy"))
        .when(k % 9 == 4, in_words)
        .when(k % 9 == 5, F.date_format(d, "dd-MMM-yyyy"))
        .when(k % 9 == 6, F.concat(F.concat_ws("-", yy, mm, dd), F.lit(" 23:59:59")))
        .when(k % 9 == 7, F.concat_ws("/", yy, mm, dd))
        .otherwise(day_first)
    )
    return j.select(
        k.cast("string").alias("Código"),
        month_text.alias("Mês"),
        date_text.alias("Data"),
        description.alias("Descrição"),
        account.alias("Origem"),
        category.alias("Categoria Dashboard"),
        F.when(k % 7 == 3, F.lit("Custos Marta")).otherwise(F.col("c_mktsegment")).alias("Categoria Original (Excel)"),
        F.when(k % 101 == 0, F.lit(""))
        .when(k % 11 == 0, F.concat(F.lit("("), brl, F.lit(")")))
        .otherwise(F.concat(F.lit("R$ "), brl)).alias("Valor Real Dashboard"),
        eur.alias("Valor Euro Dashboard"),
        F.when(k % 10 < 8, F.lit("Sim")).otherwise(F.lit("Não")).alias("Entra Custo Pessoal?"),
        F.concat((k % 3 + 1).cast("string"), F.lit(" de 3")).alias("Parcela Compra"),
    )


def items_sheet(spark: SparkSession, sf_dir: str, item_header: str = "Item") -> DataFrame:
    """Dirty item sheet (``fact_marta`` / ``fact_aluguel``) from line items and parts."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    word = F.substring_index(F.col("p_name"), " ", -1)
    item = F.lit(ITEM_DEFAULT)
    for w, name in reversed(ITEM_BY_WORD):
        item = F.when(word == w, F.lit(name)).otherwise(item)
    p = table(spark, sf_dir, "part").select("p_partkey", item.alias("item"))  # once a part, not once a line
    j = li.join(p, li.l_partkey == p.p_partkey)
    d = _shifted(F.col("l_shipdate"))
    month_text = (
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format(d, "MM/yyyy"))
        .otherwise(F.concat(_pick(MONTH_NAMES_PT, F.month(d)), F.lit(" "), F.date_format(d, "yyyy")))
    )
    return j.select(
        month_text.alias("Mês"),
        F.col("item").alias(item_header),
        F.concat(F.lit("R$ "), brl_text(F.col("l_extendedprice"))).alias("Valor Real Dashboard"),
    )


def revenue_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty monthly revenue sheet (``dim_meses``): net line revenue by ship month."""
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", "l_shipdate")
    d = _shifted(F.col("l_shipdate"))
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    monthly = li.groupBy(F.date_format(d, "yyyy").alias("y"), F.month(d).alias("m")).agg(F.sum(net).alias("rev"))
    return monthly.select(
        F.concat(_pick(MONTH_LABEL_PT, F.col("m")), F.lit("/"), F.col("y")).alias("Mês"),
        F.translate(F.col("rev").cast("string"), ".", ",").alias("Receita Salário"),
    )


BET_TYPES = (("purchase", "bet"), ("signup", "bet retorno"), ("error", "levantamento"))


def betting_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty betting sheet (``fact_apostas_kto``) from events."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    kind = F.col("event_type")
    for ev, name in reversed(BET_TYPES):
        kind = F.when(F.col("event_type") == ev, F.lit(name)).otherwise(kind)
    return e.select(
        F.date_format("ts", "dd/MM/yyyy").alias("Mês"),
        F.date_format("ts", "yyyy-MM-dd").alias("Data"),
        kind.alias("Tipo"),
        F.concat(F.lit("KTO "), F.col("event_type")).alias("Descrição"),
        F.concat(F.lit("R$ "), brl_text(F.col("value"))).alias("Valor Real Dashboard"),
    )


def categories_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension (``dim_categorias``): one row per nation, grouped by region."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.initcap(F.col("n_name")).alias("Categoria Dashboard"), F.col("r_name").alias("Grupo"))


def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly balance (``fact_balanco_mensal``) from orders: revenue and cost text."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderdate")
    d = _shifted(F.col("o_orderdate"))
    m = o.groupBy(F.date_format(d, "MM/yyyy").alias("mes")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("rev"))
    return m.select(
        F.col("mes").alias("Mês"),
        F.translate(F.col("rev").cast("string"), ".", ",").alias("Receita Líquida"),
        F.translate((F.col("rev") * F.lit(0.6).cast("decimal(2,1)")).cast("string"), ".", ",").alias("Custo Total"),
    )


def notes_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model notes (``README_modelo``): one row per region."""
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_name").alias("Seção"), F.concat(F.lit("Região "), F.col("r_name")).alias("Descrição"))


def workbook(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All eight raw sheets, keyed by table name."""
    return {
        "fact_transacoes": ledger_sheet(spark, sf_dir),
        "dim_meses": revenue_sheet(spark, sf_dir),
        "dim_categorias": categories_sheet(spark, sf_dir),
        "fact_marta": items_sheet(spark, sf_dir, "Item"),
        "fact_aluguel": items_sheet(spark, sf_dir, "Rubrica"),
        "fact_apostas_kto": betting_sheet(spark, sf_dir),
        "fact_balanco_mensal": balance_sheet(spark, sf_dir),
        "README_modelo": notes_sheet(spark, sf_dir),
    }
