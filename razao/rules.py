"""Business vocabulary of a ledger, handed to every operator as one object.

Nothing here touches data. ``LedgerRules`` bundles the column roles, the term
lists and the labels; every operator takes ``rules`` and never hard-codes a
business word. Term lists are stored already normalized (lower case, accents
stripped), because every match runs on normalized text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Fixed values. These must equal the source ledger's vocabulary for the
# results to be the same; they are listed plainly and in natural order.
# --------------------------------------------------------------------------

TRUTHY = ("sim", "s", "yes", "true", "1")
FALSY = ("nao", "n", "no", "false", "0")

TOTAL_PATTERN = (
    r"\b(?:total|subtotal|sub\s*total|custo\s*total|receita\s*liquida|saldo\s*final)\b"
)

PAYOUT_CATEGORIES = ("bet retorno", "retorno bet", "aposta retorno", "apostas retorno")
STAKE_CATEGORIES = ("bet", "aposta", "apostas", "kto")
BET_CATEGORIES = ("bet", "bet retorno")

SETTLEMENT_TERMS = ("fatura", "pagamento de fatura", "pagamento cartao")
CARD_CATEGORIES = ("cartao de credito", "cartao credito")
CARD_SOURCE_TERMS = ("cartao de credito",)
ADJUSTMENT_TERMS = ("ajuste", "abatimento")

SHARED_HOME_CATEGORY = "custo de casa"
SHARED_HOME_NAMES = (
    "aluguel",
    "condominio",
    "cota extra canalizacao ac",
    "cota extra canalizacao ac 9 de 10",
    "fundo de reserva",
    "funesbom",
    "iptu",
    "iptu 1 de 10",
    "iptu 10 de 10",
    "seguro incendio",
    "seguro de incendio",
    "taxa bancaria",
    "luz",
    "gas",
    "celular",
    "internet + tv",
)

TECHNICAL_CATEGORIES = ("Receita mensal", "Ajuste/abatimento", "Transporte público")

RECEIVABLE_TERMS = (
    "aluguel",
    "aluguer",
    "alugue",
    "condominio",
    "iptu",
    "internet",
    "tv",
    "seguro telemovel",
    "celular",
    "telefone",
    "telemovel",
    "movel",
    "wellhub",
    "gympass",
    "gym pass",
    "luz",
    "gas",
)
REBATE_PATTERN = r"\b(?:wellhub|gym\s*pass|gympass|gypass)\b"
EXCLUSIVE_TERMS = ("seguro telemovel", "seguro celular", "f1 tv")

# Utility classes in the order they are tested; a later match overrides an
# earlier one.
UTILITY_CLASSES = (
    ("Luz", r"\bluz\b|energia|eletric"),
    ("Gás", r"\bgas\b"),
    ("Celular", r"celular|telemovel|telefone"),
    ("Internet + TV", r"internet|tv"),
)

BET_FALLBACK_STAKE = r"bet|aposta|invest"
BET_FALLBACK_PAYOUT = r"retorno|levant|saque"

# Portuguese month words, tested in this order (first match wins).
MONTH_WORDS = (
    ("jan", 1), ("janeiro", 1), ("fev", 2), ("fevereiro", 2), ("mar", 3), ("marco", 3),
    ("abr", 4), ("abril", 4), ("mai", 5), ("maio", 5), ("jun", 6), ("junho", 6),
    ("jul", 7), ("julho", 7), ("ago", 8), ("agosto", 8), ("set", 9), ("setembro", 9),
    ("out", 10), ("outubro", 10), ("nov", 11), ("novembro", 11), ("dez", 12), ("dezembro", 12),
)
MONTH_LABELS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
ENGLISH_MONTHS = (
    ("jan", 1), ("january", 1), ("feb", 2), ("february", 2), ("mar", 3), ("march", 3),
    ("apr", 4), ("april", 4), ("may", 5), ("jun", 6), ("june", 6), ("jul", 7), ("july", 7),
    ("aug", 8), ("august", 8), ("sep", 9), ("sept", 9), ("september", 9), ("oct", 10),
    ("october", 10), ("nov", 11), ("november", 11), ("dec", 12), ("december", 12),
)

REASON_INVALID = "valor nulo ou inválido"
REASON_TOTAL = "total/subtotal"
REASON_PAYOUT = "categoria Bet retorno"
REASON_STAKE = "categoria Bet"
REASON_NOT_INCLUDED = "entra_custo_pessoal = Não"
REASON_OTHER = "outros"

NO_MONTH_LABEL = "Sem mês"
NO_SOURCE_LABEL = "Sem origem"
OTHERS_LABEL = "Outros"
CARD_LABEL = "Cartão de Crédito"
REVENUE_LABEL = "Receita mensal"

RECEIVABLE_HOUSE_TYPE = "Custo de casa"
RECEIVABLE_REBATE_TYPE = "Abatimento Wellhub"
RECEIVABLE_TOTAL_TYPE = "Total"
RECEIVABLE_TOTAL_ITEM = "Total a receber da Marta"
GROUP_TOTAL = "Total"
GROUP_REBATE = "Abatimentos"
GROUP_EXCLUSIVE = "Custos exclusivos Marta"
GROUP_SHARED = "Custos partilhados"
GROUP_OTHER = "Outros itens"
GROUP_ORDER = (GROUP_SHARED, GROUP_EXCLUSIVE, GROUP_REBATE, GROUP_OTHER)
TYPE_ORDER = (RECEIVABLE_HOUSE_TYPE, RECEIVABLE_REBATE_TYPE, RECEIVABLE_TOTAL_TYPE)
TOTAL_KIND = "total"
REBATE_KIND = "abatimento"
REBATE_ITEM = "wellhub"
HOUSE_RAW_CATEGORY = "custos marta"
HOUSE_SOURCE_RENT = "fact_aluguel"
HOUSE_SOURCE_TX = "fact_transacoes / Custos Marta"
BET_STAKE_LABEL = "Investido"
BET_PAYOUT_LABEL = "Levantado"

CASH_NOTES = (
    ("Cartão de Crédito", "Valor pago referente à fatura do cartão de crédito do mês anterior, que saiu da conta corrente."),
    ("Custo de casa", "Custo de casa (aluguel + contas / 2) + outros custos de casa que saíram da conta corrente."),
)
CASH_NOTE_DEFAULT = "Gasto que saiu da conta corrente."
ACCRUAL_NOTES = (
    ("Cartão de Crédito", "Valor total do cartão de crédito do mês corrente."),
    ("Ajuste/abatimento", "Abatimentos, estornos ou ajustes que reduzem ou corrigem o total do mês."),
    ("Custo de casa", "Custo total de casa saído da conta corrente + gasto de casa no cartão de crédito desse mês."),
)
ACCRUAL_NOTE_TEMPLATE = ("Custo total de ", " saído da conta corrente + gasto no cartão de crédito desse mês.")
DISPLAY_SUFFIX = " ⓘ"

TABLE_NAMES = (
    "fact_transacoes",
    "dim_meses",
    "dim_categorias",
    "fact_marta",
    "fact_aluguel",
    "fact_apostas_kto",
    "fact_balanco_mensal",
    "README_modelo",
)
LEDGER_TABLE = "fact_transacoes"
EXPECTED_COLUMNS = (
    ("fact_transacoes", ("mes", "descricao", "origem", "categoria_dashboard", "categoria_original_excel",
                         "valor_real_dashboard", "valor_euro_dashboard", "entra_custo_pessoal", "parcela_compra")),
    ("dim_meses", ("mes",)),
    ("fact_marta", ("mes",)),
    ("fact_aluguel", ("mes",)),
    ("fact_apostas_kto", ("mes",)),
)
ISSUE_NOT_LOADED = "Aba não carregada."
ISSUE_MISSING_COLUMNS = "Colunas esperadas ausentes: "
ISSUE_TOTAL_LINES = " linha(s) parecem total/subtotal e serão ignoradas nos cálculos."
ISSUE_NO_MONTH = " linha(s) sem mês reconhecido."
ISSUE_NO_AMOUNT = " linha(s) sem valor em R$ válido."
ISSUE_NO_CATEGORY = "Existem transações sem categoria_dashboard preenchida."
LEVEL_ERROR = "erro"
LEVEL_WARNING = "aviso"

DEFAULT_YEAR = 2026
SHARE_FACTOR = "0.5"
UTILITY_FACTOR = 2


@dataclass(frozen=True)
class Roles:
    """Which input column plays which part. Names are normalized headers."""

    month_text: str = "mes"
    year: str = "ano"
    month_num: str = "mes_num"
    date: str = "data"
    description: str = "descricao"
    account: str = "origem"
    category: str = "categoria_dashboard"
    raw_category: str = "categoria_original_excel"
    amount: str = "valor_real_dashboard"
    amount_alt: str = "valor_euro_dashboard"
    include_flag: str = "entra_custo_pessoal"
    instalment: str = "parcela_compra"
    cost_name: str = "nome_custo"
    item: str = "item"
    kind: str = "tipo"
    rubric: str = "rubrica"
    source_stake: str = "is_bet"
    source_payout: str = "is_bet_retorno"
    # Fallbacks used when the preferred column is missing (ledger only).
    account_alias: str = "fonte"
    description_alias: str = "nome_custo"
    # Money columns scaled by the shared-home factor.
    share_columns: tuple[str, ...] = ("valor_real", "valor_euro", "valor_real_dashboard", "valor_euro_dashboard")
    # Columns that get a normalized ``<name>_norm`` twin.
    norm_columns: tuple[str, ...] = (
        "descricao", "origem", "categoria_dashboard", "categoria_original_excel",
        "entra_custo_pessoal", "parcela_compra", "nome_custo", "item", "tipo",
    )
    # Columns joined to look for total lines.
    total_text_columns: tuple[str, ...] = (
        "descricao", "categoria_dashboard", "categoria_original_excel", "nome_custo", "item", "tipo",
    )
    # Type repair by column name.
    date_prefix: str = "data"
    date_names: tuple[str, ...] = ("date",)
    number_terms: tuple[str, ...] = ("valor", "receita", "salario", "aluguel", "saldo")
    cost_term: str = "custo"
    text_names: tuple[str, ...] = ("nome_custo", "descricao", "categoria_dashboard", "categoria_original_excel")
    text_prefixes: tuple[str, ...] = ("entra_", "categoria_", "tipo_", "descricao_")
    value_terms: tuple[str, ...] = ("valor", "custo")
    revenue_terms: tuple[str, ...] = ("salario", "receita")
    item_candidates: tuple[str, ...] = ("rubrica", "item", "descricao", "nome_custo")

    @property
    def number_name(self) -> re.Pattern:
        """The names of money columns: a money term, or the cost term in a name that isn't the
        include flag's; never a text column's name or a name with a text prefix."""
        never = "|".join([*(rf"{re.escape(n)}$" for n in self.text_names), *map(re.escape, self.text_prefixes)])
        terms = "|".join(map(re.escape, self.number_terms))
        cost = re.escape(self.cost_term)
        return re.compile(rf"(?!{never})(?:.*(?:{terms})|(?!entra_{cost}).*{cost})")


@dataclass(frozen=True)
class LedgerRules:
    """Everything business-specific, with the source ledger's values as defaults.

    Options that deviate from the source behaviour are off by default:
    ``paren_after_currency`` (D4), ``whole_word`` item matching (D22),
    ``exclusive_bet_fallback`` (D13).
    """

    roles: Roles = field(default_factory=Roles)
    default_year: int = DEFAULT_YEAR
    # Sums of this type have 38 digits, of which 30 stand before the mark.
    money_precision: int = 28
    money_scale: int = 8
    share_factor: str = SHARE_FACTOR
    utility_factor: int = UTILITY_FACTOR
    truthy: tuple[str, ...] = TRUTHY
    falsy: tuple[str, ...] = FALSY
    total_pattern: str = TOTAL_PATTERN
    payout_categories: tuple[str, ...] = PAYOUT_CATEGORIES
    stake_categories: tuple[str, ...] = STAKE_CATEGORIES
    bet_categories: tuple[str, ...] = BET_CATEGORIES
    settlement_terms: tuple[str, ...] = SETTLEMENT_TERMS
    card_categories: tuple[str, ...] = CARD_CATEGORIES
    card_source_terms: tuple[str, ...] = CARD_SOURCE_TERMS
    adjustment_terms: tuple[str, ...] = ADJUSTMENT_TERMS
    shared_home_category: str = SHARED_HOME_CATEGORY
    shared_home_names: tuple[str, ...] = SHARED_HOME_NAMES
    technical_categories: tuple[str, ...] = TECHNICAL_CATEGORIES
    receivable_terms: tuple[str, ...] = RECEIVABLE_TERMS
    rebate_pattern: str = REBATE_PATTERN
    exclusive_terms: tuple[str, ...] = EXCLUSIVE_TERMS
    utility_classes: tuple[tuple[str, str], ...] = UTILITY_CLASSES
    bet_fallback_stake: str = BET_FALLBACK_STAKE
    bet_fallback_payout: str = BET_FALLBACK_PAYOUT
    house_raw_category: str = HOUSE_RAW_CATEGORY
    total_kind: str = TOTAL_KIND
    rebate_kind: str = REBATE_KIND
    rebate_item: str = REBATE_ITEM
    type_order: tuple[str, ...] = TYPE_ORDER
    paren_after_currency: bool = False
    whole_word: bool = False
    exclusive_bet_fallback: bool = False

    @property
    def money_type(self) -> str:
        return f"decimal({self.money_precision},{self.money_scale})"


DEFAULT_RULES = LedgerRules()
