"""Text functions as native Spark expressions (STR-1..5).

``normalize`` reproduces Python's ``strip().lower()`` + NFKD + drop combining
marks + collapse whitespace without a UDF: the NFKD table is generated once
from ``unicodedata`` on the driver and shipped inside the plan, most of it as a
``translate`` map, so the work stays on the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

class _Folds(dict):
    """What each lower-case character becomes: its compatibility decomposition without combining marks."""

    def __missing__(self, code: int) -> str:
        out = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = out
        return out


_FOLDS = _Folds()
# Hangul syllables decompose by arithmetic: first consonants, vowels and last consonants.
HANGUL = ("가", "힣")
_JAMO = tuple("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


@lru_cache(maxsize=1)
def _tables():
    """(translate source, translate target, characters that become several, their
    forms, whitespace characters), over all of Unicode but the Hangul syllables.

    The translate map sends every lower-case character to its form when that is
    one character, deletes combining marks, and sends every whitespace
    character to a plain space.
    """
    space = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    src, dst, drop, multi = [], [], [], []
    for cp in [*range(0x80, ord(HANGUL[0])), *range(ord(HANGUL[1]) + 1, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(cp)
        # upper-case input is lower-cased before the map is applied
        if ch in space or ch.lower() != ch or (out := _FOLDS[cp]) == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(" " if out.isspace() else out)
        elif out:
            multi.append((ch, out))
        else:
            drop.append(ch)
    for ch in space:
        if ch != " ":
            src.append(ch)
            dst.append(" ")
    # translate() deletes source characters that have no counterpart, so the
    # dropped ones go last.
    return "".join(src) + "".join(drop), "".join(dst), "".join(a for a, _ in multi), tuple(b for _, b in multi), space


def whitespace_chars() -> str:
    """Python's ``str.isspace`` set (the Java regex ``\\s`` is ASCII only)."""
    return _tables()[4]


def strip(c: Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends (no regex)."""
    return F.btrim(c, F.lit(whitespace_chars()))


def strip_rare(c: Column) -> Column:
    """:func:`strip` where few texts need it: one that begins and ends with a printable ASCII character is left as it is."""
    plain = F.ascii(c).between(0x21, 0x7E) & F.ascii(F.substring(c, -1, 1)).between(0x21, 0x7E)
    return F.when(plain, c).otherwise(strip(c))


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces -> one space; the regex only runs on rows that need it."""
    return F.when(F.instr(c, "  ") > 0, F.regexp_replace(c, " {2,}", " ")).otherwise(c)


def _ascii_spaces(t: Column) -> Column:
    """Every white space character of an ASCII text as a space: plain byte searches, cheaper than a map over all characters."""
    for ch in whitespace_chars():
        if ch.isascii() and ch != " ":
            t = F.replace(t, F.lit(ch), F.lit(" "))
    return t


def sql_literal(text: str) -> str:
    """A Spark SQL string literal; non-ASCII and control characters as \\u escapes."""
    out = []
    for ch in text:
        o = ord(ch)
        if ch in "'\\":
            out.append("\\" + ch)
        elif o > 0xFFFF:
            hi, lo = 0xD800 + ((o - 0x10000) >> 10), 0xDC00 + ((o - 0x10000) & 0x3FF)
            out.append("\\u%04x\\u%04x" % (hi, lo))
        elif o < 0x20 or o > 0x7E:
            out.append("\\u%04x" % o)
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def _expanded(t: Column) -> Column:
    """The text with each of its characters that become several replaced by them, one replacement for each
    different such character that it holds."""
    _, _, chars, forms, _ = _tables()
    known = F.map_from_arrays(F.split(F.lit(chars), ""), F.split(F.lit("|".join(forms)), "[|]"))
    lead, vowel, tail = map(F.lit, _JAMO)

    def form(c: Column) -> Column:
        n = F.ascii(c) - ord(HANGUL[0])
        syllable = F.concat(F.substr(lead, F.floor(n / 588).cast("int") + 1, F.lit(1)),
                            F.substr(vowel, F.floor(n % 588 / 28).cast("int") + 1, F.lit(1)),
                            F.when(n % 28 > 0, F.substr(tail, n % 28, F.lit(1))).otherwise(F.lit("")))
        return F.when(c.between(*HANGUL), syllable).otherwise(F.element_at(known, c))

    odd = F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    several = F.filter(odd, lambda c: c.between(*HANGUL) | (F.translate(c, chars, "") == ""))
    return F.aggregate(several, t, lambda text, c: F.replace(text, c, form(c)))


def normalize(c: Column | str) -> Column:
    """STR-1: NULL -> '', strip, lower, NFKD, drop combining marks, collapse spaces.

    Pass a column name to reuse the expression built for that name (building
    one costs driver round trips; the result is the same).
    """
    return _normalize_named(c) if isinstance(c, str) else _normalize_column(c)


@lru_cache(maxsize=256)
def _normalize_named(name: str) -> Column:
    return _normalize_column(F.col(f"`{name}`"))


def _normalize_column(c: Column) -> Column:
    """ASCII texts only have their white space folded. In others one ``translate`` does NFKD, mark removal
    and white space, after the characters that become several are expanded."""
    src, dst, _, _, _ = _tables()
    t = F.lower(strip(c.cast("string")))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.coalesce(collapse_spaces(F.when(ascii_only, _ascii_spaces(t)).otherwise(F.translate(_expanded(t), src, dst))), F.lit(""))


def normalize_py(value) -> str:
    """Driver-side form of :func:`normalize` for schema names and term lists: the same table."""
    return re.sub(r"\s+", " ", "" if value is None else str(value).strip().lower().translate(_FOLDS))


def normalize_terms(terms) -> tuple[str, ...]:
    """Normalize a term list once and drop duplicates, keeping first order (D20)."""
    seen: dict[str, None] = {}
    for t in terms:
        seen.setdefault(normalize_py(t), None)
    return tuple(seen)


def escape_regex(term: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def full_match(c: Column, alternatives) -> Column:
    """STR-2 full match against literal alternatives: plain equality, no regex."""
    return c.isin(list(alternatives))


def contains_any(c: Column, terms, whole_word: bool = False, loose_spaces: bool = False) -> Column:
    """STR-2 any-of substring test, one regex instead of an OR chain.

    ``loose_spaces`` lets a space in a term match a run of spaces, which makes
    a search over fields joined with spaces equal to one over the joined text
    with its spaces collapsed.
    """
    parts = [escape_regex(t) for t in terms]
    if loose_spaces:
        parts = [p.replace(" ", " +") for p in parts]
    alt = "|".join(parts)
    if whole_word:
        return c.rlike(rf"\b(?:{alt})\b")
    if len(terms) == 1 and not loose_spaces:
        return c.contains(terms[0])
    return c.rlike(f"(?:{alt})")


def concat_text(*cols: Column) -> Column:
    """STR-3: join with a space, NULL taken as empty (unlike ``concat_ws``)."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def truncate(c: Column, n: int) -> Column:
    """STR-4."""
    return F.substring(c, 1, n)


def list_summary(values: Column, default: str, count_label: str = " selecionados",
                 range_form: bool = False, count: Column | None = None) -> Column:
    """STR-5 on an array column: up to three joined with ', ', else a range or a count.

    ``count`` is the number of values when ``values`` holds only the first few
    (see ``aggregates.smallest_values``)."""
    n = F.size(values) if count is None else count
    many = (
        F.concat(F.element_at(values, 1), F.lit(" a "), F.element_at(values, -1))
        if range_form
        else F.concat(n.cast("string"), F.lit(count_label))
    )
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(default))
        .when(n <= 3, F.array_join(values, ", "))
        .otherwise(many)
    )
