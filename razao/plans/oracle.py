"""DuckDB SQL for the correctness check.

The oracle never parses the dirty text: it starts from the clean columns of
the test tables (the true amount, date and month of each row) and applies
the business rules with DuckDB's own string functions. The Spark side parses
the dirty sheets through the library, so a match checks the parsers and the
rules together.
"""

from __future__ import annotations

# The source's vocabulary, written out again so that a wrong value in the rules can't match itself.
ISSUE_TOTAL_LINES = " linha(s) parecem total/subtotal e serão ignoradas nos cálculos."
ISSUE_NO_MONTH = " linha(s) sem mês reconhecido."
ISSUE_NO_AMOUNT = " linha(s) sem valor em R$ válido."
ISSUE_NO_CATEGORY = "Existem transações sem categoria_dashboard preenchida."
TRUTHY = ('sim', 's', 'yes', 'true', '1')
FALSY = ('nao', 'n', 'no', 'false', '0')
PAYOUT_CATEGORIES = ('bet retorno', 'retorno bet', 'aposta retorno', 'apostas retorno')
STAKE_CATEGORIES = ('bet', 'aposta', 'apostas', 'kto')
CARD_CATEGORIES = ('cartao de credito', 'cartao credito')
SHARED_HOME_NAMES = ('aluguel',
 'condominio',
 'cota extra canalizacao ac',
 'cota extra canalizacao ac 9 de 10',
 'fundo de reserva',
 'funesbom',
 'iptu',
 'iptu 1 de 10',
 'iptu 10 de 10',
 'seguro incendio',
 'seguro de incendio',
 'taxa bancaria',
 'luz',
 'gas',
 'celular',
 'internet + tv')
TECHNICAL_CATEGORIES = ('Receita mensal', 'Ajuste/abatimento', 'Transporte público')
REASON_INVALID = 'valor nulo ou inválido'
REASON_TOTAL = 'total/subtotal'
REASON_PAYOUT = 'categoria Bet retorno'
REASON_STAKE = 'categoria Bet'
REASON_NOT_INCLUDED = 'entra_custo_pessoal = Não'
NO_MONTH_LABEL = 'Sem mês'
RECEIVABLE_HOUSE_TYPE = 'Custo de casa'
RECEIVABLE_REBATE_TYPE = 'Abatimento Wellhub'
RECEIVABLE_TOTAL_TYPE = 'Total'
RECEIVABLE_TOTAL_ITEM = 'Total a receber da Marta'
GROUP_EXCLUSIVE = 'Custos exclusivos Marta'
HOUSE_SOURCE_TX = 'fact_transacoes / Custos Marta'
CASH_NOTES = (('Cartão de Crédito', 'Valor pago referente à fatura do cartão de crédito do mês anterior, que saiu da conta corrente.'),
 ('Custo de casa', 'Custo de casa (aluguel + contas / 2) + outros custos de casa que saíram da conta corrente.'))
CASH_NOTE_DEFAULT = 'Gasto que saiu da conta corrente.'
ACCRUAL_NOTES = (('Cartão de Crédito', 'Valor total do cartão de crédito do mês corrente.'),
 ('Ajuste/abatimento', 'Abatimentos, estornos ou ajustes que reduzem ou corrigem o total do mês.'),
 ('Custo de casa', 'Custo total de casa saído da conta corrente + gasto de casa no cartão de crédito desse mês.'))
ACCRUAL_NOTE_TEMPLATE = ('Custo total de ', ' saído da conta corrente + gasto no cartão de crédito desse mês.')


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def norm(expr: str) -> str:
    """DuckDB twin of the text normalizer (ASCII whitespace suffices for these tables)."""
    return f"coalesce(trim(regexp_replace(strip_accents(lower(trim({expr}))), '\\s+', ' ', 'g')), '')"


MONTHS = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez']"


def label(period: str) -> str:
    return f"({MONTHS}[CAST(substr({period}, 6, 2) AS INTEGER)] || '/' || substr({period}, 1, 4))"


def label_or_empty(period: str) -> str:
    return f"CASE WHEN {period} IS NULL THEN {q(NO_MONTH_LABEL)} ELSE {label(period)} END"


def money(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def sum0(expr: str) -> str:
    return f"CAST(coalesce(sum({expr}), 0) AS DOUBLE)"


TOTAL_RE = "\\b(total|subtotal|sub\\s*total|custo\\s*total|receita\\s*liquida|saldo\\s*final)\\b"

# Ledger L: truth columns from orders x customer.
LEDGER = f"""
base AS (
  SELECT o.o_orderkey AS k, o.o_orderpriority AS pri, o.o_orderstatus AS st, o.o_totalprice AS x,
         CAST(o.o_orderdate + INTERVAL 25 YEAR AS DATE) AS d, c.c_name, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
raw AS (
  SELECT k,
    CASE WHEN k % 211 = 0 THEN '' WHEN pri = '1-URGENT' AND k % 10 = 7 THEN 'Bet retorno'
         WHEN pri = '1-URGENT' THEN 'Bet' WHEN pri = '2-HIGH' THEN 'Custo de casa'
         WHEN pri = '3-MEDIUM' THEN 'Mercado' WHEN pri = '4-NOT SPECIFIED' THEN 'Ajuste/abatimento'
         ELSE 'Lazer' END AS category,
    CASE st WHEN 'F' THEN 'Cartão de Crédito' WHEN 'O' THEN 'Conta Corrente' ELSE 'Poupança' END AS account,
    CASE WHEN k % 97 = 0 THEN 'Total do mês' WHEN k % 13 = 0 THEN 'Pagamento de fatura'
         WHEN k % 5 = 0 THEN 'Luz' WHEN k % 5 = 1 THEN '  Condomínio ' ELSE c_name END AS description,
    CASE WHEN k % 7 = 3 THEN 'Custos Marta' ELSE c_mktsegment END AS raw_category,
    CASE WHEN k % 10 < 8 THEN 'Sim' ELSE 'Não' END AS include_flag,
    CASE WHEN k % 101 = 0 THEN NULL WHEN k % 11 = 0 THEN -CAST(x AS DECIMAL(18,2))
         ELSE CAST(x AS DECIMAL(18,2)) END AS amount,
    CAST(CAST(round(x * 100) AS BIGINT) // 6 AS DECIMAL(18,2)) * 0.01 AS amount_alt,
    CAST(k % 3 + 1 AS VARCHAR) || ' de 3' AS instalment,
    strftime(d, '%Y-%m') AS period, d AS date
  FROM base),
normed AS (
  SELECT *, {norm('category')} AS category_n, {norm('description')} AS description_n,
         {norm('account')} AS account_n, {norm('raw_category')} AS raw_category_n,
         {norm('include_flag')} AS include_n,
         regexp_matches({norm("concat_ws(' ', description, category, raw_category)")}, '{TOTAL_RE}') AS is_total_line
  FROM raw),
flagged AS (
  SELECT *,
    category_n IN {in_list(PAYOUT_CATEGORIES)} AS is_payout,
    category_n IN {in_list(STAKE_CATEGORIES)} AND NOT category_n IN {in_list(PAYOUT_CATEGORIES)} AS is_stake,
    regexp_matches(trim(regexp_replace(category_n || ' ' || description_n || ' ' || account_n, '\\s+', ' ', 'g')),
                   '\\b(fatura|pagamento de fatura|pagamento cartao)\\b')
      OR category_n IN {in_list(CARD_CATEGORIES)} AS is_card_settlement,
    include_n IN {in_list(TRUTHY)} AS include
  FROM normed),
L AS (
  SELECT *,
    (include OR is_card_settlement) AND amount IS NOT NULL AND NOT is_total_line AND NOT is_stake
      AND NOT is_payout AS is_personal_cost,
    CASE WHEN amount IS NULL THEN {q(REASON_INVALID)} WHEN is_total_line THEN {q(REASON_TOTAL)}
         WHEN is_payout THEN {q(REASON_PAYOUT)} WHEN is_stake THEN {q(REASON_STAKE)}
         WHEN NOT is_card_settlement AND NOT include THEN {q(REASON_NOT_INCLUDED)} ELSE '' END AS exclusion_reason,
    amount IS NOT NULL AND NOT is_total_line AND NOT is_stake AND NOT is_payout AS valid_base,
    regexp_matches(account_n, 'cartao de credito') AS card_source,
    regexp_matches(category_n, 'ajuste|abatimento') AS adjustment,
    category_n = 'custo de casa' AND description_n IN {in_list(SHARED_HOME_NAMES)} AS shared_home
  FROM flagged),
cash AS (
  SELECT *, CASE WHEN shared_home THEN amount * 0.5 ELSE amount END AS cost
  FROM L WHERE valid_base AND NOT card_source AND NOT adjustment AND (include OR is_card_settlement)),
accrual AS (
  SELECT *, CASE WHEN shared_home THEN amount * 0.5 ELSE amount END AS cost
  FROM L WHERE valid_base AND include AND NOT is_card_settlement),
card AS (
  SELECT period, sum(amount) AS amount FROM L WHERE valid_base AND card_source AND period IS NOT NULL
  GROUP BY period HAVING sum(amount) <> 0)"""

# Items I: truth columns from lineitem x part.
ITEMS = """
ibase AS (
  SELECT strftime(CAST(l.l_shipdate + INTERVAL 25 YEAR AS DATE), '%Y-%m') AS period,
         CASE split_part(p.p_name, ' ', -1) WHEN 'anvil' THEN 'Aluguel' WHEN 'bolt' THEN 'Luz'
              WHEN 'gear' THEN 'Gás' WHEN 'gizmo' THEN 'Internet + TV' WHEN 'plate' THEN 'Gympass'
              WHEN 'ring' THEN 'Seguro telemóvel' WHEN 'rod' THEN 'Total contas' ELSE 'Mercearia' END AS item,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
I AS (
  SELECT *, strip_accents(lower(item)) AS item_n,
         regexp_matches(strip_accents(lower(item)), '\\b(total|subtotal|sub\\s*total|custo\\s*total|receita\\s*liquida|saldo\\s*final)\\b') AS is_total_line
  FROM ibase)"""

# Revenue R: net line revenue by shifted ship month.
REVENUE = """
R AS (
  SELECT strftime(CAST(l_shipdate + INTERVAL 25 YEAR AS DATE), '%Y-%m') AS period,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
  FROM lineitem GROUP BY 1)"""

# Betting E: events as stakes, payouts and withdrawals by day.
BETS = """
E AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS period,
         CASE event_type WHEN 'purchase' THEN 'bet' WHEN 'signup' THEN 'bet retorno' WHEN 'error' THEN 'levantamento'
              ELSE event_type END AS kind,
         CAST(round(value, 2) AS DECIMAL(18,2)) AS amount
  FROM events)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)
