"""Dates, months and month labels as native expressions (DAT-1..4, PRJ-1 parts).

Every branch of the month grammar is guarded by a regex on the shape of the
text, so one branch cannot swallow another's input, and each branch uses
``try_*`` functions so a bad cell gives NULL instead of failing the task.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import normalize, strip


_DIGITS = "0123456789"

# A time of day after a date, with an optional zone.
TIME = r"(?i)[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?$"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+)?"


def _to_date(t: Column, pattern: str) -> Column:
    return F.try_to_date(t, pattern)


def _word_map(words) -> Column:
    return F.create_map(*[x for w, n in words for x in (F.lit(w), F.lit(n))])


def _word_alternation(words) -> str:
    return "|".join(w for w, _ in sorted(words, key=lambda x: -len(x[0])))


def without_time(t: Column) -> Column:
    """The text without a time of day at its end; the regex runs only where there is a colon."""
    return F.when(F.instr(t, ":") > 0, F.regexp_replace(t, TIME, "")).otherwise(t)


def skeleton(t: Column) -> Column:
    """The text with its digits removed: ``'01/02/2026'`` -> ``'//'``. Date and
    month shapes are told apart with it by plain string tests, not regexes."""
    return F.translate(t, _DIGITS, "")


def _has_letters(skel: Column) -> Column:
    return F.lower(skel) != F.upper(skel)


def _date_of(t: Column, skel: Column) -> Column:
    """DAT-1 on text stripped of surrounding whitespace and of a time, with its skeleton."""
    slashed = F.translate(t, "-.", "//")
    parts = F.split(slashed, "/")
    l1 = F.length(F.element_at(parts, 1))
    l3 = F.length(F.element_at(parts, 3))
    second = F.element_at(parts, 2).try_cast("int")
    two_seps = skel.isin("--", "//", "..")
    return (
        F.when(skel.isin("--", "//") & (l1 == 4), _to_date(slashed, "yyyy/M/d"))
        .when(two_seps & (l1 <= 2) & (l3 == 4), F.when(second <= 12, _to_date(slashed, "d/M/yyyy"))
              .otherwise(_to_date(slashed, "M/d/yyyy")))
        .when(two_seps & (l1 <= 2) & (l3 == 2), F.when(second <= 12, _to_date(slashed, "d/M/yy"))
              .otherwise(_to_date(slashed, "M/d/yy")))
        .when((skel == "") & (F.length(t) == 8), _to_date(t, "yyyyMMdd"))
        .when(_has_letters(skel), _date_in_words(F.lower(t)))
    )


def _date_in_words(low: Column) -> Column:
    """``5 mar 2026``, ``05-mar-26``, ``march 5, 2026``, each after an optional weekday."""
    month = _word_alternation(R.ENGLISH_MONTHS)
    day, sep = r"(\d{1,2})(?:st|nd|rd|th)?", r"[ ./,-]+"
    number = _word_map(R.ENGLISH_MONTHS)

    def built(pattern: str, d: int, m: int) -> Column:
        at = lambda i: F.regexp_extract(low, pattern, i)
        year = F.when(F.length(at(3)) == 2, F.concat(F.lit("20"), at(3))).otherwise(at(3))
        return _to_date(F.concat_ws("-", year, F.element_at(number, at(m)).cast("string"), at(d)), "yyyy-M-d")

    return F.coalesce(built(rf"^{WEEKDAY}{day}{sep}({month}){sep}(\d{{4}}|\d{{2}})$", 1, 2),
                      built(rf"^{WEEKDAY}({month}){sep}{day}{sep}(\d{{4}})$", 2, 1))


def _period(year: Column, month: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def _checked(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), _period(year, month))


def _month_of(t: Column, skel: Column, norm: Column, default_year: int) -> Column:
    """DAT-2 on text stripped of surrounding whitespace and of a time, with its skeleton, and on
    its normalized form without dots."""
    full = F.date_format(_date_of(t, skel), "yyyy-MM")
    parts = F.split(F.translate(t, "-.", "//"), "/")
    p1, p2 = F.element_at(parts, 1), F.element_at(parts, 2)
    one_sep = skel.isin("/", "-", ".")
    month_year = F.when(one_sep & (F.length(p1) <= 2) & (F.length(p2) == 4), _checked(p2, p1.try_cast("int")))
    year_month = F.when(one_sep & (F.length(p1) == 4) & (F.length(p2) <= 2), _checked(p1, p2.try_cast("int")))
    year_only = F.when((skel == "") & (F.length(t) == 4), F.concat(t, F.lit("-01")))

    low = F.lower(t)
    eng_re = rf"^(?:\d{{1,2}}[\s/.,-]+)?({_word_alternation(R.ENGLISH_MONTHS)})[\s/.,-]+(\d{{4}})$"
    eng_month = F.element_at(_word_map(R.ENGLISH_MONTHS), F.regexp_extract(low, eng_re, 1))
    english = F.when(_has_letters(skel) & eng_month.isNotNull(), _period(F.regexp_extract(low, eng_re, 2), eng_month))

    bare = F.when((norm != "") & (skeleton(norm) == ""), _checked(F.lit(default_year), norm.try_cast("int")))
    year_text = F.regexp_extract(norm, r"\b(20\d{2})\b", 1)
    year = F.when(year_text != "", year_text).otherwise(F.lit(str(default_year)))
    words = F.regexp_extract_all(norm, F.lit(rf"\b({_word_alternation(R.MONTH_WORDS)})\b"), 1)
    word_map = _word_map(R.MONTH_WORDS)
    word_month = F.array_min(F.transform(words, lambda w: F.element_at(word_map, w)))
    portuguese = F.when(_has_letters(skel), F.when(word_month.isNotNull(), _period(year, word_month)))

    result = F.coalesce(full, month_year, year_month, year_only, english, bare, portuguese)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("string")).otherwise(result)


def parse_date(c: Column) -> Column:
    """DAT-1: ``Y-m-d``, then ``d/m/Y``, then ``m/d/Y``, then other day-first shapes.

    Also ``d-m-Y``, ``d.m.Y``, ``d/m/yy``, ``YYYYMMDD``, ``Y/m/d`` and dates with an
    English month word (``5 Mar 2026``, ``05-Mar-2026``, ``March 5, 2026``). A time
    of day after any of them is dropped. Failure -> NULL. For whole tables use
    :func:`with_date`, which computes each intermediate once.
    """
    t = without_time(strip(c.cast("string")))
    return _date_of(t, skeleton(t))


def parse_month(c: Column, default_year: int = R.DEFAULT_YEAR) -> Column:
    """DAT-2: month text -> ``YYYY-MM``; NULL when nothing is recognized.

    Order: full date; ``m/Y``; ``Y-m``; ``Y`` (January); English month word
    with a 4-digit year; bare 1-12 (default year); Portuguese month word as a
    whole word, year ``20dd`` when present else the default year. When several
    Portuguese words occur, the earliest in the word list wins, i.e. the
    smallest month number. ISO dates keep their month (the day/month swap of
    a day-first parser is not reproduced). Whole tables use :func:`with_month`.
    """
    t = without_time(strip(c.cast("string")))
    return _month_of(t, skeleton(t), F.replace(normalize(c), F.lit("."), F.lit("")), default_year)


@lru_cache(maxsize=256)
def _date_stages(name: str):
    """The projections of DAT-1 for a column name. They depend on names only, so they are built
    once per process and reused (building a Column costs driver round trips)."""
    t, sk = f"__{name}_stripped", f"__{name}_skeleton"
    return ((t, without_time(strip(F.col(name).cast("string")))), (sk, skeleton(F.col(t))), _date_of(F.col(t), F.col(sk)))


@lru_cache(maxsize=256)
def _month_stages(name: str, default_year: int):
    t, n, sk = f"__{name}_stripped", f"__{name}_nodots", f"__{name}_skeleton"
    first = {t: without_time(strip(F.col(name).cast("string"))), n: F.replace(normalize(name), F.lit("."), F.lit(""))}
    return first, (sk, skeleton(F.col(t))), _month_of(F.col(t), F.col(sk), F.col(n), default_year), (t, n, sk)


def with_date(df, name: str, out: str | None = None):
    """DAT-1 over a table column in short projections (strip once, then parse)."""
    (tmp, stripped), (sk, skel), parsed = _date_stages(name)
    return (df.withColumn(tmp, stripped).withColumn(sk, skel)
              .withColumn(out or name, parsed).drop(tmp, sk))


def with_month(df, name: str, out: str, default_year: int = R.DEFAULT_YEAR):
    """DAT-2 over a table column in two projections (strip and normalize once)."""
    first, (sk, skel), parsed, temps = _month_stages(name, default_year)
    return df.withColumns(dict(first)).withColumn(sk, skel).withColumn(out, parsed).drop(*temps)


def period_from_parts(year: Column, month: Column) -> Column:
    """PRJ-1 first branch: numeric year + month (1-12, truncated) -> ``YYYY-MM``."""
    y = strip(year.cast("string")).try_cast("double")
    m = strip(month.cast("string")).try_cast("double")
    valid = y.isNotNull() & m.isNotNull() & m.between(1, 12)
    return F.when(valid, F.concat(y.cast("long").cast("string"), F.lit("-"),
                                  F.lpad(m.try_cast("int").cast("string"), 2, "0")))


def period_of_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_label(p: Column, labels=R.MONTH_LABELS, empty: str = R.NO_MONTH_LABEL) -> Column:
    """DAT-3: ``2026-03`` -> ``Mar/2026``; NULL/'' -> ``Sem mês``; odd text as is."""
    parts = F.split(p, "-")
    month_txt = F.element_at(parts, 2)
    month_num = month_txt.try_cast("int")
    names = F.array(*[F.lit(x) for x in labels])
    name = F.when(month_num.between(1, len(labels)), F.element_at(names, month_num)).otherwise(month_txt)
    label = F.concat(name, F.lit("/"), F.element_at(parts, 1))
    return (
        F.when(p.isNull() | (p == ""), F.lit(empty))
        .when((F.size(parts) < 2) | month_num.isNull(), p)
        .otherwise(label)
    )


def format_date(d: Column) -> Column:
    """DAT-4: ``dd/MM/yyyy``."""
    return F.date_format(d, "dd/MM/yyyy")
