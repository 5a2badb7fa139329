"""DuckDB SQL twin of every catalogue query (see ``plans.oracle`` for the
truth CTEs). Keys and column names match ``plans.catalogue.QUERIES``."""

from __future__ import annotations

from . import catalogue as K
from .oracle import (FALSY, TRUTHY, ISSUE_NO_AMOUNT, ISSUE_NO_CATEGORY, ISSUE_NO_MONTH, ISSUE_TOTAL_LINES, BETS, ITEMS, LEDGER, REVENUE, in_list, label, label_or_empty, norm, q, sum0, with_ctes,
                     ACCRUAL_NOTES, ACCRUAL_NOTE_TEMPLATE, CASH_NOTES, CASH_NOTE_DEFAULT, FALSY, GROUP_EXCLUSIVE, HOUSE_SOURCE_TX, RECEIVABLE_HOUSE_TYPE, RECEIVABLE_REBATE_TYPE, RECEIVABLE_TOTAL_ITEM, RECEIVABLE_TOTAL_TYPE, TECHNICAL_CATEGORIES, TRUTHY)

RECEIVABLE_RE = "aluguel|aluguer|alugue|condominio|iptu|internet|tv|seguro telemovel|celular|telefone|telemovel|movel|wellhub|gympass|gym pass|luz|gas"
REBATE_RE = "\\b(wellhub|gym\\s*pass|gympass|gypass)\\b"
NON_BET = "NOT (is_stake OR is_payout OR category_n IN ('bet', 'bet retorno'))"
TECH = f"NOT coalesce(category IN {in_list(TECHNICAL_CATEGORIES)}, false)"


def brl(expr: str, symbol: str = "R$") -> str:
    return f"'{symbol} ' || translate(format('{{:,.2f}}', CAST(coalesce({expr}, 0) AS DOUBLE)), ',.', '.,')"


def pct_text(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN '—' ELSE replace(printf('%.1f', {expr}), '.', ',') || '%' END"


def guarded(part: str, whole: str) -> str:
    return (f"CASE WHEN coalesce(CAST({whole} AS DOUBLE), 0) = 0 THEN 0.0 "
            f"ELSE CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0 END")


def cash_note(c: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CASH_NOTES)
    return f"CASE {c} {whens} ELSE {q(CASH_NOTE_DEFAULT)} END"


def accrual_note(c: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in ACCRUAL_NOTES)
    head, tail = ACCRUAL_NOTE_TEMPLATE
    return f"CASE {c} {whens} ELSE {q(head)} || lower({c}) || {q(tail)} END"


L = with_ctes(LEDGER)
LI = with_ctes(LEDGER, ITEMS)
LR = with_ctes(LEDGER, REVENUE)

ACC = """,
acc AS (SELECT period, category, CAST(cost AS DECIMAL(38,4)) AS v FROM accrual
        UNION ALL SELECT period, 'Cartão de Crédito', CAST(amount AS DECIMAL(38,4)) FROM card),
abase AS (SELECT * FROM acc WHERE """ + TECH + ")"

RECEIVABLE_ROWS = f""",
rr AS (SELECT period, item, item_n, amount,
              regexp_matches(item_n, '{REBATE_RE}') AS is_rebate
       FROM I WHERE NOT is_total_line AND (regexp_matches(item_n, '{RECEIVABLE_RE}')
                                           OR regexp_matches(item_n, '{REBATE_RE}'))),
rows AS (SELECT period, {label('period')} AS period_label, item,
                CASE WHEN is_rebate THEN {q(RECEIVABLE_REBATE_TYPE)} ELSE {q(RECEIVABLE_HOUSE_TYPE)} END AS kind,
                CASE WHEN is_rebate THEN -abs(coalesce(amount, 0)) ELSE abs(coalesce(amount, 0)) END AS value,
                CASE WHEN is_rebate THEN 1 ELSE 0 END AS row_order, item_n
         FROM rr)"""

RECEIVABLE_GROUPS = f""",
g AS (SELECT *, CASE WHEN lower(kind) = 'total' THEN 'Total'
                     WHEN value < 0 OR contains(lower(strip_accents(kind)), 'abatimento') OR contains(item_n, 'wellhub')
                       THEN 'Abatimentos'
                     WHEN regexp_matches(item_n, 'seguro telemovel|seguro celular|f1 tv') THEN {q(GROUP_EXCLUSIVE)}
                     WHEN lower(strip_accents(kind)) = 'custo de casa' THEN 'Custos partilhados'
                     ELSE 'Outros itens' END AS grp FROM rows)"""

HOUSE = f""",
house AS (SELECT period, item AS rubrica, amount AS value, 'fact_aluguel' AS fonte_dado FROM I
          UNION ALL
          SELECT period, description, amount, {q(HOUSE_SOURCE_TX)} FROM L
          WHERE raw_category_n = 'custos marta' AND NOT is_total_line)"""

UTILITY = f""",
util AS (SELECT period, amount,
           CASE WHEN regexp_matches(item_n, 'internet|tv') THEN 'Internet + TV'
                WHEN regexp_matches(item_n, 'celular|telemovel|telefone') THEN 'Celular'
                WHEN regexp_matches(item_n, '\\bgas\\b') THEN 'Gás'
                WHEN regexp_matches(item_n, '\\bluz\\b|energia|eletric') THEN 'Luz' END AS bill
         FROM I),
ubill AS (SELECT period, bill, sum(amount) * 2 AS value FROM util
          WHERE bill IS NOT NULL AND period IS NOT NULL GROUP BY period, bill)"""

CASH_SERIES = """,
m AS (SELECT period, sum(cost) AS cash_out FROM cash WHERE period IS NOT NULL GROUP BY period),
rv AS (SELECT period, sum(revenue) AS revenue FROM R WHERE period IS NOT NULL GROUP BY period),
series AS (SELECT m.period, coalesce(rv.revenue, 0) AS revenue, m.cash_out,
                  CAST(m.cash_out AS DOUBLE) - CAST(lag(m.cash_out) OVER (ORDER BY m.period) AS DOUBLE) AS change
           FROM m LEFT JOIN rv USING (period))"""


def _summary(chosen: str, one: bool) -> str:
    change = "max(change)" if one else "CAST(NULL AS DOUBLE)"
    return LR + CASH_SERIES + f""",
sel AS (SELECT * FROM series WHERE {chosen}),
rsel AS (SELECT coalesce(sum(revenue), 0) AS revenue FROM R WHERE {chosen})
SELECT CAST((SELECT revenue FROM rsel) AS DOUBLE) AS revenue, CAST(coalesce(sum(cash_out), 0) AS DOUBLE) AS cash_out,
       CAST(sum(cash_out) AS DOUBLE) / count(cash_out) AS mean_monthly_cash_out,
       CAST(arg_max(cash_out, period) AS DOUBLE) AS latest_cash_out, count(*) AS months,
       (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) FROM cash) AS year_total,
       CAST((SELECT revenue FROM rsel) - coalesce(sum(cash_out), 0) AS DOUBLE) AS balance,
       {guarded('coalesce(sum(cash_out), 0)', '(SELECT revenue FROM rsel)')} AS consumed_pct,
       {change} AS change_vs_previous
FROM sel"""


def _evolution(chosen: str) -> str:
    return LR + ACC + f""",
big AS (SELECT category FROM (SELECT category, sum(v) AS t FROM abase WHERE category IS NOT NULL GROUP BY category) ORDER BY t DESC, category LIMIT 5),
sel AS (SELECT * FROM abase WHERE category IN {chosen}),
present AS (SELECT DISTINCT period FROM acc WHERE period IS NOT NULL AND period <> ''),
e AS (SELECT period, category, CAST(sum(v) AS DOUBLE) AS value, sum(v) AS exact FROM sel
      WHERE period IS NOT NULL AND category IS NOT NULL GROUP BY period, category
      UNION ALL
      SELECT period, 'Receita mensal', CAST(sum(revenue) AS DOUBLE), sum(revenue) FROM R
      WHERE period IN (SELECT period FROM present) GROUP BY period)"""


def _bet_fallback(exclusive: bool) -> str:
    stake = "regexp_matches(kind, 'bet|aposta|invest')"
    payout = "regexp_matches(kind, 'retorno|levant|saque')"
    if exclusive:
        stake = f"({stake} AND NOT {payout})"
    return with_ctes(BETS) + f""",
f AS (SELECT day, coalesce(sum(CASE WHEN {stake} THEN amount END), 0) AS staked,
             coalesce(sum(CASE WHEN {payout} THEN amount END), 0) AS returned
      FROM E GROUP BY day)
SELECT day AS period, {label('day')} AS period_label, CAST(staked AS DOUBLE) AS staked,
       CAST(returned AS DOUBLE) AS returned, CAST(returned - staked AS DOUBLE) AS balance,
       CAST(sum(returned - staked) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance
FROM f"""


def _sample(columns: str, where: str) -> str:
    return L + f"""
SELECT date AS data, {label_or_empty('period')} AS period_label, account AS origem, category AS categoria_dashboard,
       raw_category AS categoria_original_excel, description AS descricao, CAST(amount AS DOUBLE) AS valor_real_dashboard,
       include_flag AS entra_custo_pessoal, {columns}
FROM L WHERE {where} ORDER BY k LIMIT 100"""


def _issue(table: str, count_sql: str, suffix: str) -> str:
    return (f"SELECT {q(table)} AS table_name, 'aviso' AS level, CAST(n AS VARCHAR) || {q(suffix)} AS message "
            f"FROM ({count_sql}) t(n) WHERE n > 0")


ISSUES = [
    _issue("fact_transacoes", "SELECT count(*) FROM L WHERE is_total_line", ISSUE_TOTAL_LINES),
    _issue("fact_transacoes", "SELECT count(*) FROM L WHERE amount IS NULL", ISSUE_NO_AMOUNT),
    f"SELECT 'fact_transacoes', 'aviso', {q(ISSUE_NO_CATEGORY)} FROM (SELECT count(*) AS n FROM L "
    "WHERE coalesce(trim(category), '') = '') t WHERE n > 0",
    _issue("dim_categorias", "SELECT count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", ISSUE_NO_MONTH),
    _issue("fact_marta", "SELECT count(*) FROM I WHERE is_total_line", ISSUE_TOTAL_LINES),
    _issue("README_modelo", "SELECT count(*) FROM region", ISSUE_NO_MONTH),
]

SQL: dict[str, str] = {
    "header_standardize": "SELECT n_nationkey AS codigo_da_nacao, n_name AS nome_pais, n_regionkey AS regiao_no, "
                          "n_name AS nome_pais_2 FROM nation",
    "drop_blank_rows": "SELECT c_custkey AS codigo, c_name AS nome, c_mktsegment AS segmento FROM customer "
                       "WHERE NOT (c_custkey % 17 = 0 OR c_custkey % 23 = 0)",
    "alias_and_provenance": L + " SELECT k AS codigo, account AS origem, description AS descricao, "
                                "'fact_transacoes' AS source_table FROM L",
    "type_repair": L + " SELECT k AS codigo, date, CAST(amount AS DOUBLE) AS amount, "
                       "CAST(amount_alt AS DOUBLE) AS amount_alt, period FROM L",
    "resolve_columns": with_ctes(ITEMS, REVENUE) + """
SELECT 'fact_marta' AS table_name, 'valor_real_dashboard' AS value_column, 'item' AS item_column,
       count(*) AS row_count, CAST(sum(amount) AS DOUBLE) AS value_total, count(DISTINCT item) AS distinct_items FROM I
UNION ALL SELECT 'fact_aluguel', 'valor_real_dashboard', 'rubrica', count(*), CAST(sum(amount) AS DOUBLE),
       count(DISTINCT item) FROM I
UNION ALL SELECT 'dim_meses', 'receita_salario', NULL, count(*), CAST(sum(revenue) AS DOUBLE), 0 FROM R""",
    "csv_round_trip": """SELECT s_suppkey, s_name, s_nationkey, s_acctbal,
       CASE s_suppkey % 8 WHEN 0 THEN 'he said "hi", ' || s_name WHEN 1 THEN '  ' || s_name || ' '
            WHEN 2 THEN s_name || chr(10) || 'second line' WHEN 3 THEN '"' || s_name || '",' || chr(10) || '"a","b"'
            WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN s_name || chr(92) ELSE s_name END AS note FROM supplier""",
    "audit_pack": L + f""",
b AS (SELECT CASE WHEN NOT is_personal_cost THEN coalesce(nullif(exclusion_reason, ''), 'outros') END AS reason,
             CASE WHEN is_personal_cost THEN category END AS category, CASE WHEN is_personal_cost THEN account END AS account, period,
             amount, is_personal_cost AS personal, include_n, is_stake AND NOT is_total_line AS stake, is_payout AND NOT is_total_line AS payout FROM L),
s AS (SELECT 'exclusions' AS section, reason AS key, * FROM b WHERE reason IS NOT NULL
      UNION ALL SELECT 'categories', category, * FROM b WHERE category IS NOT NULL
      UNION ALL SELECT 'sources', account, * FROM b WHERE account IS NOT NULL
      UNION ALL SELECT 'months', period, * FROM b WHERE period IS NOT NULL
      UNION ALL SELECT 'summary', NULL, * FROM b)
SELECT section, key, count(*) AS row_count, count(*) FILTER (personal) AS rows_counted, count(*) FILTER (include_n IN {in_list(TRUTHY)}) AS yes,
       count(*) FILTER (include_n IN {in_list(FALSY)}) AS no, {sum0('amount')} AS gross, {sum0('CASE WHEN personal THEN amount END')} AS kept,
       {sum0('CASE WHEN stake THEN amount END')} AS staked, {sum0('CASE WHEN payout THEN amount END')} AS returned
FROM s GROUP BY section, key""",
    "bet_running_rows": L + """,
b AS (SELECT k, date, CASE WHEN is_payout THEN amount ELSE -amount END AS v FROM L WHERE (is_stake OR is_payout) AND NOT is_total_line)
SELECT k AS codigo, date, CAST(v AS DOUBLE) AS value, CAST(coalesce(sum(v) OVER (ORDER BY date, k ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS running,
       CAST(lag(v) OVER (ORDER BY date, k) AS DOUBLE) AS previous FROM b""",
    "month_merge": with_ctes(LEDGER, REVENUE, BETS) + """,
u AS (SELECT period, revenue AS revenue, NULL AS cash, NULL AS staked FROM R
      UNION ALL SELECT period, NULL, cost, NULL FROM cash UNION ALL SELECT period, NULL, NULL, amount FROM E WHERE kind = 'bet')
SELECT period, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue, CAST(coalesce(sum(cash), 0) AS DOUBLE) AS cash,
       CAST(coalesce(sum(staked), 0) AS DOUBLE) AS staked FROM u WHERE period IS NOT NULL GROUP BY period""",
    "distinct_estimate": L + """
SELECT period AS scope, count(DISTINCT description) AS distinct_items, true AS within_two_percent FROM L WHERE period IS NOT NULL GROUP BY period
UNION ALL SELECT 'all', count(DISTINCT description), true FROM L WHERE period IS NOT NULL""",
    "period_date_range": L + """
SELECT k AS codigo, period, date FROM L WHERE period IN ('2024-03', '2025-12', '2026-08')""",
    "term_table_search": """WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM conversations) WHERE length(term) >= 7)
SELECT doc_id, count(*) AS n_terms FROM documents JOIN t ON contains(text, term) GROUP BY doc_id""",
    "shared_home_table": L + " SELECT k AS codigo, shared_home FROM L",
    "receivable_term_table": LI + f"""
SELECT period, item, regexp_matches(item_n, '{REBATE_RE}') AS is_rebate, count(*) AS row_count FROM I
WHERE regexp_matches(item_n, '{RECEIVABLE_RE}') OR regexp_matches(item_n, '{REBATE_RE}') GROUP BY ALL""",
    "bill_term_table": LI + """
SELECT item, CASE WHEN contains(item_n, 'internet') OR contains(item_n, 'tv') THEN 'Internet + TV' WHEN contains(item_n, 'celular') OR contains(item_n, 'telemovel')
       THEN 'Celular' WHEN contains(item_n, 'gas') THEN 'Gás' WHEN contains(item_n, 'luz') THEN 'Luz' END AS bill, count(*) AS row_count FROM I GROUP BY ALL""",
    "csv_parts": """WITH c AS (SELECT c_custkey AS k, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_custkey // 500 % 3 AS layout,
       c_custkey % 50 < 2 AS ragged FROM customer)
SELECT CASE WHEN NOT ragged THEN k END AS c_custkey, CASE WHEN NOT ragged THEN name END AS c_name, CASE WHEN NOT ragged AND layout < 2 THEN cents END AS cents,
       CASE WHEN ragged THEN CASE layout WHEN 2 THEN 2 ELSE 3 END END AS expected_cells,
       CASE WHEN ragged AND k % 50 = 0 THEN CASE layout WHEN 0 THEN concat_ws(',', k, name, cents) WHEN 1 THEN concat_ws(',', cents, k, name)
              ELSE concat_ws(',', name, k) END || ',extra'
            WHEN ragged THEN CASE layout WHEN 0 THEN concat_ws(',', k, name) WHEN 1 THEN concat_ws(',', cents, k) ELSE name END END AS record
FROM c""",
    "text_normalize": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace({norm("text || ' qqzzqq'")}, 'qqzzqq', 'TM No m2 1\u20443 Ab \u1100\u1161\u11a8')
       ELSE {norm('text')} END AS text_norm FROM documents""",
    "text_tools": f"""SELECT conv_id, turn, substr(text, 1, 32) AS preview,
       coalesce(role IN ('user', 'assistant'), false) AS is_dialog_role,
       coalesce(regexp_matches({norm('text')}, 'pour|avec'), false) AS mentions_terms,
       CAST(length(concat_ws(' ', coalesce(role, ''), '', coalesce(text, ''))) AS INTEGER) AS joined_length,
       'n/a' AS lang_or_default FROM conversations""",
    "list_summary": L + """,
g AS (SELECT period,
        list_sort(list(DISTINCT account) FILTER (WHERE account IS NOT NULL AND account <> '')) AS a,
        list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL AND category <> '')) AS c
      FROM L WHERE period IS NOT NULL GROUP BY period)
SELECT period,
  CASE WHEN coalesce(len(a), 0) = 0 THEN 'Todas as origens' WHEN len(a) <= 3 THEN array_to_string(a, ', ')
       ELSE CAST(len(a) AS VARCHAR) || ' selecionados' END AS accounts_summary,
  CASE WHEN coalesce(len(c), 0) = 0 THEN 'Todas as categorias' WHEN len(c) <= 3 THEN array_to_string(c, ', ')
       ELSE CAST(len(c) AS VARCHAR) || ' selecionados' END AS categories_summary
FROM g""",
    "range_summary": L + """,
g AS (SELECT account, list_sort(list(DISTINCT period)) AS p FROM L WHERE period IS NOT NULL AND account IS NOT NULL GROUP BY account)
SELECT account AS origem, CASE WHEN len(p) <= 3 THEN array_to_string(p, ', ') ELSE p[1] || ' a ' || p[-1] END AS months_summary FROM g""",
    "number_parse_wide": """SELECT o_orderkey AS codigo,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderkey AS HUGEINT) * 1000000000000 + 0.25 AS DOUBLE)
            ELSE CAST(CAST(o_orderkey % 1000000 AS DECIMAL(18,6)) / 1000000 AS DOUBLE) END AS amount,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderkey AS HUGEINT) * 1000000000000 * 1000000 + 250000 AS VARCHAR)
            ELSE CAST(o_orderkey % 1000000 AS VARCHAR) END AS millionths FROM orders""",
    "period_by_parts": f"""WITH o AS (SELECT o_orderkey AS codigo, strftime(CAST(o_orderdate + INTERVAL 25 YEAR AS DATE), '%Y-%m') AS period FROM orders)
SELECT codigo, t AS source_table, period, {label('period')} AS period_label FROM o, (VALUES ('fact_parts'), ('fact_dates')) v(t)""",
    "clean_layout": L + f""" SELECT period, count(*) AS row_count, CAST(sum(amount) AS DOUBLE) AS total FROM L
WHERE period IN {in_list(K.SELECTED_PERIODS)} GROUP BY period""",
    "facet_table": L + """ SELECT k AS codigo, account AS origem, category AS categoria_dashboard FROM L
WHERE account <> 'Poupança' AND category NOT IN ('Bet', 'Bet retorno')""",
    "number_parse": L + " SELECT k AS codigo, CAST(amount AS DOUBLE) AS amount, amount < 0 AS is_negative FROM L",
    "money_format": f"""SELECT o_orderkey, {brl('o_totalprice')} AS money_text, {brl('o_totalprice / 6', '€')} AS money_alt_text,
       {pct_text('o_totalprice / 5000.0')} AS pct_text,
       replace(format('{{:,}}', o_orderkey * 1000), ',', '.') AS count_text,
       CASE WHEN o_orderkey % 5 = 0 THEN '—' ELSE {brl('o_totalprice')} END AS dash_text FROM orders""",
    "number_signs": f"""SELECT c_custkey,
       CASE WHEN c_acctbal IS NULL THEN 'neutral' WHEN c_acctbal < 0 THEN 'negative'
            WHEN c_acctbal > 0 THEN 'positive' ELSE 'neutral' END AS tone,
       abs(c_acctbal) AS abs_value, -c_acctbal AS negated, {guarded('c_acctbal', 'c_nationkey')} AS ratio_pct
FROM customer""",
    "date_parse": L + " SELECT k AS codigo, date, strftime(date, '%d/%m/%Y') AS date_text FROM L",
    "month_parse": L + f" SELECT k AS codigo, period, {label_or_empty('period')} AS period_label FROM L",
    "total_line_flag": L + " SELECT k AS codigo, is_total_line FROM L",
    "transaction_flags": L + " SELECT k AS codigo, is_payout, is_stake, is_card_settlement, include, "
                             "is_personal_cost FROM L",
    "exclusion_reason": L + " SELECT k AS codigo, exclusion_reason FROM L",
    "period_filter": L + f" SELECT k AS codigo, period, CAST(amount AS DOUBLE) AS amount FROM L "
                         f"WHERE period IN {in_list(K.SELECTED_PERIODS)}",
    "facet_filter": L + f""" SELECT k AS codigo, period, account AS origem, category AS categoria_dashboard FROM L
WHERE period IN {in_list(K.FACET_PERIODS)} AND account IN {in_list(K.FACET_ACCOUNTS)}
  AND category IN {in_list(K.FACET_CATEGORIES)}""",
    "facet_values": L + """
SELECT DISTINCT 'period' AS facet, period AS value FROM L WHERE period IS NOT NULL AND period <> ''
UNION ALL SELECT DISTINCT 'origem', account FROM L WHERE account IS NOT NULL AND account <> ''
UNION ALL SELECT DISTINCT 'categoria_dashboard', category FROM L WHERE category IS NOT NULL AND category <> ''""",
    "personal_costs": L + " SELECT k AS codigo, period, CAST(amount AS DOUBLE) AS amount FROM L WHERE is_personal_cost",
    "excluded_rows": L + " SELECT k AS codigo, exclusion_reason, CAST(amount AS DOUBLE) AS amount FROM L "
                         "WHERE NOT is_personal_cost",
    "non_bet_rows": L + f" SELECT k AS codigo, category AS categoria_dashboard FROM L WHERE {NON_BET}",
    "accrual_costs": L + " SELECT k AS codigo, period, CAST(cost AS DOUBLE) AS cost FROM accrual",
    "cash_costs": L + " SELECT k AS codigo, period, CAST(cost AS DOUBLE) AS cost FROM cash",
    "description_search": L + " SELECT k AS codigo, description AS descricao FROM L "
                              "WHERE contains(description_n, 'condominio')",
    "document_search": f"SELECT doc_id FROM documents WHERE regexp_matches({norm('text')}, 'ete')",
    "technical_exclusion": L + f" SELECT k AS codigo, category AS categoria_dashboard FROM L WHERE {TECH}",
    "technical_fallback": L + " SELECT k AS codigo, category AS categoria_dashboard FROM L "
                              "WHERE category = 'Ajuste/abatimento'",
    "card_statement": L + f" SELECT period, {label('period')} AS period_label, 'Cartão de Crédito' AS category, "
                          "CAST(amount AS DOUBLE) AS value FROM card",
    "monthly_sum": L + f" SELECT period, {label('period')} AS period_label, CAST(sum(cost) AS DOUBLE) AS value "
                       "FROM cash WHERE period IS NOT NULL GROUP BY period",
    "total_sum": L + " SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total FROM L",
    "cash_flow_overview": LR + CASH_SERIES + f"""
SELECT period, {label('period')} AS period_label, CAST(revenue AS DOUBLE) AS revenue,
       CAST(cash_out AS DOUBLE) AS cash_out, CAST(revenue - cash_out AS DOUBLE) AS balance,
       {guarded('cash_out', 'revenue')} AS consumed_pct, change AS change_vs_previous FROM series""",
    "cash_flow_month": _summary("period IN ('2026-03')", one=True),
    "cash_flow_selection": _summary(f"period IN {in_list(K.REVENUE_ONLY_PERIODS)}", one=False),
    "cash_flow_last_month": _summary("period = (SELECT max(period) FROM m)", one=True),
    "category_top_others": L + f""",
bc AS (SELECT category, sum(cost) AS value FROM cash WHERE category IS NOT NULL GROUP BY category),
rk AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS rn FROM bc),
t AS (SELECT CASE WHEN rn <= 2 THEN category ELSE 'Outros' END AS category, sum(value) AS value FROM rk GROUP BY 1)
SELECT category, CAST(value AS DOUBLE) AS value, {brl('value')} AS value_text, {cash_note('category')} AS note,
       category || ' ⓘ' AS display FROM t""",
    "source_composition": L + """
SELECT CASE WHEN coalesce(category = 'Cartão de Crédito', false) OR is_card_settlement THEN 'Cartão de Crédito'
            ELSE coalesce(account, 'Sem origem') END AS source, CAST(sum(cost) AS DOUBLE) AS value
FROM cash GROUP BY 1""",
    "transaction_listing": L + f"""
SELECT {label_or_empty('period')} AS "Mês", strftime(date, '%d/%m/%Y') AS "Data", description AS "Descrição",
       account AS "Origem", category AS "Categoria", raw_category AS "Categoria original",
       {brl('amount')} AS "Valor R$", {brl('amount_alt', '€')} AS "Valor €", instalment AS "Parcela",
       include_flag AS "Custo pessoal", is_card_settlement AS "Pagamento fatura",
       exclusion_reason AS "Motivo exclusão"
FROM L WHERE {NON_BET} AND contains(description_n, 'condominio') AND is_personal_cost""",
    "transaction_metrics": L + f""",
nb AS (SELECT * FROM L WHERE {NON_BET}),
big AS (SELECT amount, description FROM nb WHERE amount IS NOT NULL ORDER BY abs(amount) DESC, k LIMIT 1)
SELECT (SELECT count(*) FROM nb) AS row_count,
       (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM nb) AS total,
       (SELECT CAST(coalesce(sum(amount_alt), 0) AS DOUBLE) FROM nb) AS total_alt,
       coalesce((SELECT CAST(amount AS DOUBLE) FROM big), 0.0) AS largest_value,
       substr(coalesce((SELECT description FROM big), 'Sem descrição'), 1, 32) AS largest_label""",
    "category_ranking": L + ACC + f"""
SELECT category, CAST(sum(v) AS DOUBLE) AS value, {accrual_note('category')} AS note
FROM abase WHERE category IS NOT NULL GROUP BY category""",
    "category_headline": LR + ACC + f""",
rk AS (SELECT category, sum(v) AS value FROM abase WHERE category IS NOT NULL GROUP BY category),
top AS (SELECT * FROM rk ORDER BY value DESC, category LIMIT 3),
present AS (SELECT DISTINCT period FROM acc WHERE period IS NOT NULL AND period <> ''),
h AS (SELECT arg_max(category, value) AS leader, CAST(max(value) AS DOUBLE) AS leader_value,
             CAST(sum(value) AS DOUBLE) AS top_total,
             string_agg(category, ' | ' ORDER BY value DESC, category) AS top_names FROM top),
x AS (SELECT (SELECT CAST(coalesce(sum(v), 0) AS DOUBLE) FROM abase) AS spent,
             (SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) FROM R WHERE period IN (SELECT period FROM present)) AS revenue)
SELECT h.*, x.spent, x.revenue, {guarded('x.spent', 'x.revenue')} AS committed_pct FROM h, x""",
    "category_evolution": _evolution(in_list(K.EVOLUTION_CATEGORIES)) + f"""
SELECT period, category, value, {label('period')} AS period_label, {brl('value')} AS value_text FROM e""",
    "category_compared": _evolution("(SELECT category FROM big)") + f"""
SELECT period, category, value, {label('period')} AS period_label, {brl('value')} AS value_text FROM e""",
    "category_means": _evolution(in_list(K.EVOLUTION_CATEGORIES)) + f""",
g AS (SELECT category, CAST(sum(CAST(value AS DECIMAL(28,8))) AS DOUBLE) / count(value) AS mean FROM e GROUP BY category)
SELECT category, mean, {brl('mean')} AS mean_text FROM g""",
    "evolution_extent": L + ACC + f""",
e AS (SELECT period, category, CAST(sum(v) AS DOUBLE) AS value FROM abase
      WHERE category IN {in_list(K.EVOLUTION_CATEGORIES)} AND period IS NOT NULL GROUP BY period, category),
p AS (SELECT period,
             coalesce(sum(value) FILTER (WHERE category = 'Mercado'), 0.0) AS a,
             coalesce(sum(value) FILTER (WHERE category = 'Lazer'), 0.0) AS b,
             coalesce(sum(value) FILTER (WHERE category = 'Cartão de Crédito'), 0.0) AS c
      FROM e GROUP BY period)
SELECT min(least(a, b, c)) AS min_value, max(greatest(a, b, c)) AS max_value FROM p""",
    "source_spend": L + """
SELECT account AS source, CAST(sum(amount) AS DOUBLE) AS value,
       (SELECT count(*) FROM L WHERE is_card_settlement) AS settlement_rows
FROM L WHERE is_personal_cost AND account IS NOT NULL GROUP BY account""",
    "category_revenue": LR + ACC + f""",
pr AS (SELECT DISTINCT period FROM abase WHERE period IS NOT NULL AND period <> ''),
rv AS (SELECT period, sum(revenue) AS revenue FROM R WHERE period IN (SELECT period FROM pr) GROUP BY period),
costs AS (SELECT period, category, sum(v) AS value FROM abase
          WHERE period IS NOT NULL AND category IS NOT NULL GROUP BY period, category),
t AS (SELECT c.period, c.category, CAST(c.value AS DOUBLE) AS value, {guarded('c.value', 'rv.revenue')} AS revenue_pct,
             1 AS row_order FROM costs c LEFT JOIN rv USING (period)
      UNION ALL
      SELECT period, 'Receita mensal', CAST(revenue AS DOUBLE), 100.0, 0 FROM rv)
SELECT period, {label('period')} AS period_label, category, value, revenue_pct, row_order,
       {brl('value')} AS value_text, {pct_text('revenue_pct')} AS revenue_pct_text FROM t""",
    "receivable_statement": with_ctes(ITEMS) + RECEIVABLE_ROWS + f"""
SELECT period, period_label, item, kind, CAST(value AS DOUBLE) AS value, row_order FROM rows
UNION ALL
SELECT period, period_label, {q(RECEIVABLE_TOTAL_ITEM)}, {q(RECEIVABLE_TOTAL_TYPE)}, CAST(sum(value) AS DOUBLE), 2
FROM rows GROUP BY period, period_label""",
    "receivable_change": with_ctes(ITEMS) + RECEIVABLE_ROWS + """,
tot AS (SELECT period, period_label, CAST(sum(value) AS DOUBLE) AS value FROM rows GROUP BY period, period_label),
w AS (SELECT *, value - lag(value) OVER (ORDER BY period) AS change, lag(value) OVER (ORDER BY period) AS prev FROM tot)
SELECT period, period_label, value, change,
       CASE WHEN prev = 0 THEN NULL ELSE change / prev * 100.0 END AS change_pct,
       CASE WHEN change IS NULL THEN NULL WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction
FROM w""",
    "receivable_summary": with_ctes(ITEMS) + RECEIVABLE_ROWS + """,
tot AS (SELECT period, sum(value) AS exact, CAST(sum(value) AS DOUBLE) AS value FROM rows GROUP BY period),
w AS (SELECT *, value - lag(value) OVER (ORDER BY period) AS change FROM tot),
a AS (SELECT CAST(sum(exact) AS DOUBLE) AS period_total, CAST(sum(exact) AS DOUBLE) / count(exact) AS monthly_mean,
             arg_max(value, period) AS last_value, arg_max(change, period) AS last_change,
             arg_min(value, period) AS first_value, count(*) AS months FROM w)
SELECT *, CASE WHEN coalesce(first_value, 0) = 0 THEN NULL
               ELSE (last_value - first_value) / abs(first_value) * 100.0 END AS first_last_pct FROM a""",
    "receivable_months": with_ctes(ITEMS) + f"""
SELECT DISTINCT period, {label('period')} AS period_label FROM I WHERE period IS NOT NULL""",
    "receivable_view": with_ctes(ITEMS) + RECEIVABLE_ROWS + RECEIVABLE_GROUPS + """
SELECT grp AS "group", period, period_label, item, kind, CAST(value AS DOUBLE) AS value,
       CASE kind WHEN 'Custo de casa' THEN 0 WHEN 'Abatimento Wellhub' THEN 1 WHEN 'Total' THEN 2 ELSE 9 END AS type_order FROM g""",
    "receivable_detail": with_ctes(ITEMS) + RECEIVABLE_ROWS + RECEIVABLE_GROUPS + f"""
SELECT grp AS "group", item, kind,
       CASE WHEN GROUPING(grp, item, kind) = 0 THEN 0 WHEN GROUPING(grp, item, kind) = 7 THEN 2 ELSE 1 END AS level,
       CAST(sum(value) AS DOUBLE) AS value,
       CASE grp WHEN 'Custos partilhados' THEN 0 WHEN {q(GROUP_EXCLUSIVE)} THEN 1 WHEN 'Abatimentos' THEN 2
                WHEN 'Outros itens' THEN 3 ELSE 9 END AS group_order
FROM g GROUP BY GROUPING SETS ((grp, item, kind), (grp), ())""",
    "house_costs": LI + HOUSE + f"""
SELECT period, {label_or_empty('period')} AS period_label, rubrica, CAST(value AS DOUBLE) AS value, fonte_dado FROM house""",
    "item_summary": LI + HOUSE + UTILITY + """,
mon AS (SELECT period, sum(value) AS value FROM house WHERE period IS NOT NULL GROUP BY period),
s AS (SELECT CAST(coalesce(sum(value), 0) AS DOUBLE) AS total, count(DISTINCT rubrica) AS distinct_items FROM house)
SELECT s.total, s.distinct_items,
       coalesce((SELECT CAST(arg_max(value, period) AS DOUBLE) FROM mon), 0.0) AS last_month,
       coalesce((SELECT CAST(sum(value) AS DOUBLE) / count(value) FROM mon), 0.0) AS monthly_mean,
       (SELECT CAST(coalesce(sum(value), 0) AS DOUBLE) FROM ubill) AS utilities,
       CASE WHEN s.total = 0 THEN 0.0
            ELSE (SELECT CAST(coalesce(sum(value), 0) AS DOUBLE) FROM ubill) / s.total * 100.0 END AS utilities_pct
FROM s""",
    "item_detail": LI + HOUSE + f"""
SELECT period, {label_or_empty('period')} AS period_label, rubrica AS item, fonte_dado,
       CAST(coalesce(sum(value), 0) AS DOUBLE) AS value, {brl('sum(value)')} AS value_text
FROM house WHERE rubrica IS NOT NULL GROUP BY period, rubrica, fonte_dado""",
    "utility_monthly": with_ctes(ITEMS) + UTILITY + f"""
SELECT period, {label('period')} AS period_label, bill, CAST(value AS DOUBLE) AS value FROM ubill""",
    "bet_ledger": L + f""",
b AS (SELECT period, coalesce(sum(CASE WHEN is_stake THEN amount END), 0) AS staked,
             coalesce(sum(CASE WHEN is_payout THEN amount END), 0) AS returned
      FROM L WHERE (is_stake OR is_payout) AND NOT is_total_line AND period IS NOT NULL GROUP BY period)
SELECT period, {label('period')} AS period_label, CAST(staked AS DOUBLE) AS staked, CAST(returned AS DOUBLE) AS returned,
       CAST(returned - staked AS DOUBLE) AS balance,
       CAST(sum(returned - staked) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance
FROM b""",
    "bet_ledger_fallback": _bet_fallback(False),
    "bet_ledger_exclusive": _bet_fallback(True),
    "bet_detail": L + f"""
SELECT period, {label_or_empty('period')} AS period_label, strftime(date, '%d/%m/%Y') AS date_text,
       CASE WHEN is_payout THEN 'Levantado' ELSE 'Investido' END AS bet_type,
       description, account AS source, category,
       CAST(CASE WHEN is_stake THEN amount ELSE 0 END AS DOUBLE) AS staked,
       CAST(CASE WHEN is_payout THEN amount ELSE 0 END AS DOUBLE) AS returned,
       CASE WHEN coalesce(CAST(CASE WHEN is_stake THEN amount ELSE 0 END AS DOUBLE), 0) = 0 THEN '—'
            ELSE {brl('CASE WHEN is_stake THEN amount ELSE 0 END')} END AS staked_text,
       CASE WHEN coalesce(CAST(CASE WHEN is_payout THEN amount ELSE 0 END AS DOUBLE), 0) = 0 THEN '—'
            ELSE {brl('CASE WHEN is_payout THEN amount ELSE 0 END')} END AS returned_text,
       {brl('amount_alt', '€')} AS alt_text
FROM L WHERE (is_stake OR is_payout) AND NOT is_total_line""",
    "audit_summary": L + f"""
SELECT 0 AS position, 'Linhas carregadas em fact_transacoes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM L
UNION ALL SELECT 1, 'Linhas com entra_custo_pessoal = Sim', CAST(count(*) FILTER (WHERE include_n IN {in_list(TRUTHY)}) AS DOUBLE) FROM L
UNION ALL SELECT 2, 'Linhas com entra_custo_pessoal = Não', CAST(count(*) FILTER (WHERE include_n IN {in_list(FALSY)}) AS DOUBLE) FROM L
UNION ALL SELECT 3, 'Soma de valor_real_dashboard antes dos filtros', CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM L
UNION ALL SELECT 4, 'Soma de valor_real_dashboard depois dos filtros de gasto pessoal',
          CAST(coalesce(sum(amount) FILTER (WHERE is_personal_cost), 0) AS DOUBLE) FROM L""",
    "audit_counts": L + """
SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE is_personal_cost) AS rows_counted,
       count(*) FILTER (WHERE NOT is_personal_cost) AS rows_excluded,
       CAST(coalesce(sum(amount) FILTER (WHERE NOT is_personal_cost), 0) AS DOUBLE) AS excluded_value FROM L""",
    "audit_exclusions": L + """
SELECT coalesce(nullif(exclusion_reason, ''), 'outros') AS exclusion_reason, count(*) AS row_count,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total
FROM L WHERE NOT is_personal_cost GROUP BY 1""",
    "audit_months": L + f"""
SELECT period, {label('period')} AS period_label,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS gross,
       CAST(coalesce(sum(amount) FILTER (WHERE is_personal_cost), 0) AS DOUBLE) AS personal,
       CAST(coalesce(sum(amount) FILTER (WHERE NOT is_personal_cost), 0) AS DOUBLE) AS excluded,
       CAST(coalesce(sum(amount) FILTER (WHERE is_stake AND NOT is_total_line), 0) AS DOUBLE) AS staked,
       CAST(coalesce(sum(amount) FILTER (WHERE is_payout AND NOT is_total_line), 0) AS DOUBLE) AS returned
FROM L WHERE period IS NOT NULL GROUP BY period""",
    "audit_categories": L + """,
c AS (SELECT category, count(*) AS row_count, coalesce(sum(amount), 0) AS total FROM L
      WHERE is_personal_cost AND category IS NOT NULL GROUP BY category)
SELECT category, row_count, CAST(total AS DOUBLE) AS total,
       CASE WHEN coalesce((SELECT CAST(sum(total) AS DOUBLE) FROM c), 0) = 0 THEN 0.0
            ELSE CAST(total AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM c) * 100.0 END AS share_pct
FROM c""",
    "audit_sources": L + """
SELECT account AS source, count(*) AS row_count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total
FROM L WHERE is_personal_cost AND account IS NOT NULL GROUP BY account""",
    "audit_sample_included": _sample("instalment AS parcela_compra", "is_personal_cost"),
    "audit_sample_excluded": _sample("exclusion_reason", "NOT is_personal_cost"),
    "quality_report": LI + "\n" + "\nUNION ALL\n".join(ISSUES),
    "quality_scan": LI + "\n" + "\nUNION ALL\n".join(ISSUES),
    "quality_incomplete": LI + "\n" + "\nUNION ALL\n".join([
        "SELECT 'fact_transacoes' AS table_name, 'aviso' AS level, "
        "'Colunas esperadas ausentes: valor_euro_dashboard, parcela_compra' AS message",
        "SELECT 'fact_balanco_mensal', 'erro', 'Aba não carregada.'", *ISSUES]),
    "quality_status": LI + ", found AS (" + "\nUNION ALL\n".join(ISSUES) + """)
SELECT CASE WHEN count(*) = 0 THEN 'OK' ELSE 'Atenção' END AS status, count(*) AS issues, 'workbook' AS scope FROM found
UNION ALL SELECT 'OK', 0, 'dim_meses'""",
    "table_inventory": LI + """,
ev AS (SELECT count(*) AS n FROM events),
rv AS (SELECT count(DISTINCT strftime(CAST(l_shipdate + INTERVAL 25 YEAR AS DATE), '%Y-%m')) AS n FROM lineitem),
bal AS (SELECT count(DISTINCT strftime(CAST(o_orderdate + INTERVAL 25 YEAR AS DATE), '%Y-%m')) AS n FROM orders)
SELECT 'fact_transacoes' AS table_name, (SELECT count(*) FROM L) AS row_count,
       'codigo, mes, data, descricao, origem, categoria_dashboard, categoria_original_excel, valor_real_dashboard, valor_euro_dashboard, entra_custo_pessoal, parcela_compra, period, period_label, descricao_norm, origem_norm, categoria_dashboard_norm, categoria_original_excel_norm, entra_custo_pessoal_norm, parcela_compra_norm, is_total_line, is_payout, is_card_settlement, include, is_stake, is_personal_cost, exclusion_reason, source_table' AS columns
UNION ALL SELECT 'dim_meses', (SELECT n FROM rv),
       'mes, receita_salario, period, period_label, is_total_line, source_table'
UNION ALL SELECT 'dim_categorias', (SELECT count(*) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
       'categoria_dashboard, grupo, period, period_label, categoria_dashboard_norm, is_total_line, source_table'
UNION ALL SELECT 'fact_marta', (SELECT count(*) FROM I),
       'mes, item, valor_real_dashboard, period, period_label, item_norm, is_total_line, source_table'
UNION ALL SELECT 'fact_aluguel', (SELECT count(*) FROM I),
       'mes, rubrica, valor_real_dashboard, period, period_label, is_total_line, source_table'
UNION ALL SELECT 'fact_apostas_kto', (SELECT n FROM ev),
       'mes, data, tipo, descricao, valor_real_dashboard, period, period_label, descricao_norm, tipo_norm, is_total_line, source_table'
UNION ALL SELECT 'fact_balanco_mensal', (SELECT n FROM bal),
       'mes, receita_liquida, custo_total, period, period_label, is_total_line, source_table'
UNION ALL SELECT 'README_modelo', (SELECT count(*) FROM region),
       'secao, descricao, period, period_label, descricao_norm, is_total_line, source_table'""",
}
