"""Localized numbers and money text as native expressions (NUM-1..7).

Money is parsed into a decimal (``rules.money_type``) so that sums do not
depend on task order; it is cast to double only in final outputs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .text import strip, strip_rare


_DROP_CHARS = ("€", " ", "\u00a0", "R$")  # the sign with a letter last: spaces may part it
_OTHER_CHARS = r"[^0-9.\-]"


def _remove_currency(t: Column) -> Column:
    """Drop ``R$``, ``€``, spaces and NBSP by byte searches: a ``translate`` looks up each character as a string."""
    for dropped in _DROP_CHARS:
        t = F.replace(t, F.lit(dropped), F.lit(""))
    return t


def parse_number(c: Column, money_type: str = "decimal(28,8)", paren_after_currency: bool = False,
                 source_type=None) -> Column:
    """NUM-1 on one column (small inputs); whole tables use :func:`with_numbers`.

    * blank -> NULL; numeric input is cast directly;
    * a value wrapped in parentheses is negative; by default the test runs
      before the currency sign is removed, so ``'R$ (1,00)'`` stays positive
      (``paren_after_currency=True`` tests after removal);
    * ``R$``, ``€``, spaces and NBSP are removed;
    * with both separators the later one is the decimal mark; a lone comma is
      the decimal mark; a lone dot is a decimal point (``'1.170'`` -> 1.17);
    * other characters are dropped; anything that is still not a number
      (``'1.170.000'``) is NULL.
    """
    if isinstance(source_type, NumericType):
        return c.try_cast(money_type)
    t = strip(c.cast("string"))
    cleaned = _remove_currency(t)
    negative = _negative(cleaned if paren_after_currency else t)
    return _finish(_keep_number_chars(_digits(cleaned)), negative, money_type)


def _negative(t: Column) -> Column:
    return F.coalesce(t.startswith("(") & t.endswith(")"), F.lit(False))


def _digits(cleaned: Column) -> Column:
    has_comma = F.instr(cleaned, ",") > 0
    has_dot = F.instr(cleaned, ".") > 0
    comma_last = F.instr(F.substring_index(cleaned, ".", -1), ",") > 0
    swapped = F.replace(F.replace(cleaned, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    unified = (
        F.when(has_comma & has_dot & comma_last, swapped)
        .when(has_comma & has_dot, F.replace(cleaned, F.lit(","), F.lit("")))
        .when(has_comma, swapped)
        .otherwise(cleaned)
    )
    return unified


def _keep_number_chars(u: Column) -> Column:
    """Drop every character but digits, '.' and '-'; the replacement runs only when needed."""
    return F.when(u.rlike(_OTHER_CHARS), F.regexp_replace(u, _OTHER_CHARS, "")).otherwise(u)


def _finish(digits: Column, negative: Column, money_type: str) -> Column:
    value = F.when(digits.isin("", "-", "."), F.lit(None)).otherwise(digits.try_cast(money_type))
    return F.when(negative, -value).otherwise(value).cast(money_type)


def with_numbers(df, names, money_type: str = "decimal(28,8)", paren_after_currency: bool = False):
    """NUM-1 over table columns in short projections, so each intermediate text
    is computed once per row (and the generated code stays small)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [n for n in names if not isinstance(types[n], NumericType)]
    df = df.withColumns({n: F.col(n).try_cast(money_type) for n in names if n not in text})
    if not text:
        return df
    for stage in range(6):
        df = df.withColumns(dict(_number_stage(n, stage, money_type, paren_after_currency) for n in text))
    return df.drop(*[f"__{n}_{s}" for n in text for s in ("t", "c", "neg", "u", "d")])


@lru_cache(maxsize=512)
def _number_stage(n: str, stage: int, money_type: str, paren_after_currency: bool):
    """(output name, expression) of one NUM-1 stage for a column name, built once
    per process (expressions depend on names only)."""
    if stage == 0:
        return f"__{n}_t", strip_rare(F.col(n).cast("string"))
    if stage == 1:
        return f"__{n}_c", _remove_currency(F.col(f"__{n}_t"))
    if stage == 2:
        return f"__{n}_neg", _negative(F.col(f"__{n}_c" if paren_after_currency else f"__{n}_t"))
    if stage == 3:
        return f"__{n}_u", _digits(F.col(f"__{n}_c"))
    if stage == 4:
        return f"__{n}_d", _keep_number_chars(F.col(f"__{n}_u"))
    return n, _finish(F.col(f"__{n}_d"), F.col(f"__{n}_neg"), money_type)


def _grouped(x: Column, decimals: int) -> Column:
    """'1,234.50' (US grouping) -> '1.234,50'."""
    return F.translate(F.format_number(x.cast("double"), decimals), ",.", ".,")


def format_money(x: Column, symbol: str = "R$") -> Column:
    """NUM-2: ``R$ 1.234,56``; NULL -> zero."""
    return F.concat(F.lit(symbol + " "), _grouped(F.coalesce(x.cast("double"), F.lit(0.0)), 2))


def format_pct(x: Column, dash: str = "—") -> Column:
    """NUM-3: ``7,4%``; NULL -> dash. Rounds half-even on the binary value."""
    text = F.translate(F.call_function("format_number", x.cast("double"), F.lit("0.0")), ".", ",")
    return F.when(x.isNull(), F.lit(dash)).otherwise(F.concat(text, F.lit("%")))


def sign_class(x: Column) -> Column:
    """NUM-4: negative / neutral / positive."""
    return (
        F.when(x.isNull(), F.lit("neutral"))
        .when(x < 0, F.lit("negative"))
        .when(x > 0, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def guarded_pct(part: Column, whole: Column, zero_value=0.0) -> Column:
    """NUM-5: part / whole * 100 in double; ``zero_value`` when whole is 0 or NULL."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    if zero_value is None:
        return F.when(whole.cast("double") == 0, F.lit(None).cast("double")).otherwise(ratio)
    return F.when(F.coalesce(whole.cast("double"), F.lit(0.0)) == 0, F.lit(float(zero_value))).otherwise(ratio)


def format_count(n: Column) -> Column:
    """NUM-6: ``12.345``."""
    return F.translate(F.format_number(n.cast("double"), 0), ",", ".")


def money_or_dash(x: Column, symbol: str = "R$", dash: str = "—") -> Column:
    """NUM-7: money text, or a dash when zero or NULL."""
    return F.when(F.coalesce(x.cast("double"), F.lit(0.0)) == 0, F.lit(dash)).otherwise(format_money(x, symbol))
