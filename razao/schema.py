"""Names of derived columns and schema-time helpers (no data is read here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .functions.nulls import first_present
from .functions.text import normalize_py
import re

PERIOD = "period"
PERIOD_LABEL = "period_label"
PERIOD_FROM = "period_from"  # only where a table's periods came from its dates
FROM_DATE = "date"
IS_TOTAL = "is_total_line"
IS_PAYOUT = "is_payout"
IS_STAKE = "is_stake"
IS_SETTLEMENT = "is_card_settlement"
INCLUDE = "include"
IS_PERSONAL = "is_personal_cost"
REASON = "exclusion_reason"
SOURCE_TABLE = "source_table"
NORM_SUFFIX = "_norm"


def norm(name: str) -> str:
    return name + NORM_SUFFIX


def header(name) -> str:
    """SRC-2 on one header: its runs of letters and digits, joined by '_'."""
    return "_".join(re.findall("[a-z0-9]+", normalize_py(name)))


def standard_names(names) -> list[str]:
    """SRC-2 on a header row, with duplicates suffixed ``_2``, ``_3``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        base = header(raw) or f"column_{i + 1}"
        n = seen.get(base, 0) + 1
        seen[base] = n
        name = base if n == 1 else f"{base}_{n}"
        while name in seen and n > 1:
            n += 1
            name = f"{base}_{n}"
        if n > 1:
            seen[name] = 1
        out.append(name)
    return out


def value_column(df: DataFrame, preferred: str = "valor_real_dashboard",
                 terms=("valor", "custo")) -> str | None:
    """SRC-9: preferred column, else the first numeric column whose name holds a term.

    A text column is never picked (fix of the name-only rule).
    """
    if preferred in df.columns:
        return preferred
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    for c in df.columns:
        if c in numeric and any(t in c for t in terms):
            return c
    return None


def item_column(df: DataFrame, fallback: str | None = "item",
                candidates=("rubrica", "item", "descricao", "nome_custo")) -> str | None:
    """SRC-10: first present of fallback, then the candidates."""
    return first_present(df, [fallback, *candidates])


def revenue_column(df: DataFrame, terms=("salario", "receita")) -> str | None:
    """SRC-11: first column whose name holds a revenue term."""
    for c in df.columns:
        if any(t in c for t in terms):
            return c
    return None


def empty_frame(spark: SparkSession, ddl: str) -> DataFrame:
    """SRC-12: typed empty result."""
    return spark.createDataFrame([], ddl)
