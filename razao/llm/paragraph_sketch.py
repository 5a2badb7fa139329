"""Operator 9: document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraphs: its lines, longer ones cut further by their own
content (``CUT``). From ``LEAST`` characters on a piece ends at the next sentence
end of any script, from ``LONG`` on also after one of some characters picked in
every script of the basic plane (about one in twenty), and at ``MOST`` anyhow;
so prose, data and scripts without spaces are all cut, and soon after a change
the cuts are the old ones again. A paragraph's digest is its XXH64. A sketch has three
subtables of cells; a digest falls into one cell of each, and a cell holds how
many fell in, the XOR of them and the XOR of their checks. A sketch's size follows
the number of paragraphs (``cells``), so its work and its length do too.

Sketches are rows (row, s, size, t, c, n, key, chk), one a cell in use, and all
steps are aggregations by cell. Two sketches of one shape subtract by adding the
cells of the one and the negative cells of the other; what both texts hold
vanishes. Peeling (``peeled``) then recovers the differing digests: a cell with
count 1 or -1 whose check fits holds exactly one, which is taken out of its cells
in the other two subtables, one subtable after the other. If cells are left, that
sketch alone is made again at twice the size, until it peels (``recovered``).

A fingerprint is the text's own sketch as text, at the first size at which it
peels by itself; so a stored fingerprint holds all its digests, and ``differences``
compares stored ones alone: it peels them, deals the digests of both at the larger
one's size, subtracts and peels. ``edited_and_next`` has the digests at hand and
starts with the dealing. The likeness is the share of common paragraphs among all,
from the two sizes and the number of recovered differences; ``differences`` also
returns the digests themselves.

The rows of one document are dealt to one task by its row number; every step after
that finds them there, so peeling shuffles nothing.

Defined results: a null text is an empty one; empty paragraphs don't count; two
texts without paragraphs have likeness 1; the only document is its own next one;
documents of one id follow each other by the text's hash, a null id comes first;
repeated rows give repeated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lowest, written

#: Cells a subtable: for each paragraph, and beside that.
PER_PARAGRAPH, SPARE = 1.25, 8
#: Subtables peeled one after the other, in turns, before a sketch counts as failed.
STEPS = 15
#: Digests that a task peels at a time, so that their cells stay in memory, and the most tasks; beyond these cells are spilled.
TASK_DIGESTS, MOST_TASKS = 100_000, 20_000
#: Neighbouring documents that are dealt to one bucket, and how many bounds there are at most.
BUCKET_ROWS, BOUND_BITS, SAMPLE_A_BOUND = 2000, 15, 4
#: Characters from which on a piece ends at a sentence end, from which on after a picked character, and at most.
LEAST, LONG, MOST = 96, 128, 320


def stripes(low: int, high: int, step: int, wide: int) -> str:
    """``wide`` characters of each ``step`` as the inside of a regex class."""
    return "".join(f"{chr(a)}-{chr(a + wide - 1)}" if wide > 1 else chr(a) for a in range(low, high, step))


# Each wide class stands behind a test for its whole range, so that other characters don't pay for it.
_PICKED = (r"(?<=[a-i0-4A-M][bgkvyBGKTVY38,;|}\t])"
           + f"|(?<=[{chr(0x370)}-{chr(0x1FFF)}])(?<=[{stripes(0x373, 0x2000, 16, 1)}])"
           + f"|(?<=[{chr(0x3040)}-{chr(0xD7FF)}])(?<=[{stripes(0x3043, 0x3100, 16, 1)}{stripes(0x3400, 0xD700, 256, 16)}])")
_STOP = r"(?<=[.!?…։؟۔।॥])(?= )|(?<=[。！？｡])"
_END = r"(?=\n)|(?![\s\S])"
#: Line breaks, or a piece as the only group.
CUT = (rf"\n+|([^\n]{{{LEAST},{LONG - 1}}}?(?:{_END}|{_STOP})|[^\n]{{{LONG},{MOST}}}?(?:{_END}|{_STOP}|{_PICKED})|[^\n]{{1,{MOST}}})")


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(CUT), F.lit(1)), lambda p: p != ""), lambda p: F.xxhash64(p)))


CELL = ("row", "s", "size", "t", "c")
FOUND = 3  # stands in place of a subtable's number at a recovered digest


def cells(paragraphs: Column) -> Column:
    """Cells a subtable for a number of paragraphs."""
    return (F.ceil(paragraphs * PER_PARAGRAPH) + SPARE).cast("int")


def check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(9)), 32)


def spot(key: Column, t: int, size: Column) -> Column:
    """The cell of a digest in a subtable."""
    return F.pmod(F.xxhash64(key, F.lit(t)), size).cast("bigint")


def held(t: Column, c: Column, n: Column, key: Column, chk: Column) -> Column:
    """What a row adds to a cell, with its place."""
    return F.struct(t.cast("int").alias("t"), c.cast("bigint").alias("c"), n.cast("int").alias("n"), key.cast("bigint").alias("key"), chk.cast("bigint").alias("chk"))


def added(rows: DataFrame, what: Column) -> DataFrame:
    """One row a cell, with all that ``what`` (an array of ``held``) adds to it; cells that hold nothing vanish."""
    spread = rows.select("row", "s", "size", F.explode(what).alias("x")).select("row", "s", "size", "x.*")
    return spread.groupBy(*CELL).agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")).where(
        "n <> 0 or key <> 0 or chk <> 0")


def one_set(s: int, size: Column, sign: int, keys: Column) -> Column:
    return F.struct(F.lit(s).alias("s"), size.alias("size"), F.lit(sign).alias("sign"), keys.alias("keys"))


def sketched(rows: DataFrame) -> DataFrame:
    """The cells of all digest sets of rows (row, sets); sets of one s are added up, so that sign -1 subtracts."""
    sets = rows.select("row", F.explode("sets").alias("x")).select("row", "x.*")
    keys = sets.select("row", "s", "size", "sign", F.explode("keys").alias("k"))
    k, size, sign = F.col("k"), F.col("size"), F.col("sign")
    return added(keys, F.array(*[held(F.lit(t), spot(k, t, size), sign, k, check(k)) for t in range(3)]))


def peeled(sketch: DataFrame, keep: bool = False) -> DataFrame:
    """The recovered digests of every sketch (t = ``FOUND``; counted, or with ``keep`` one a row, its side as n), and the
    cells that are left of those that failed."""
    n, key, chk = F.col("n"), F.col("key"), F.col("chk")
    out = held(F.lit(FOUND), key, n, key, F.lit(0)) if keep else held(F.lit(FOUND), F.lit(0), F.lit(1), F.lit(0), F.lit(0))
    same = F.array(held(F.col("t"), F.col("c"), n, key, chk))
    for step in range(STEPS):
        pure = (F.col("t") == step % 3) & (F.abs(n) == 1) & (chk == check(key))
        taken = [held(F.lit(t), spot(key, t, F.col("size")), -n, key, chk) for t in range(3) if t != step % 3]
        sketch = added(sketch, F.when(pure, F.array(out, *taken)).otherwise(same))
    return sketch


def recovered(rows: DataFrame, keep: bool = False) -> DataFrame:
    """How many digests each sketch s of rows (row, sets) recovers, at the first level at which it peels; a level doubles the
    size: (row, s, level, differ), with ``keep`` also their digests (added, removed). A sketch without a cell has no row.

    ``rows`` lie dealt by ``row`` over a written table. Each level is a job of its own over the sketches that failed."""
    found, level, failed = [], 0, None
    while failed is None or not failed.isEmpty():
        mine = rows
        if failed is not None:
            again = rows.join(failed.groupBy("row").agg(F.collect_set("s").alias("again")), "row")
            mine = again.select("row", F.transform(F.filter("sets", lambda x: F.array_contains("again", x["s"])), lambda x: x.withField("size", x["size"] * (1 << level))).alias("sets"))
        is_found = F.col("t") == FOUND
        sides = [F.collect_list(F.when(is_found & (F.col("n") == n), F.col("key"))).alias(name) for n, name in ((1, "added"), (-1, "removed"))]
        ends = peeled(sketched(mine), keep).groupBy("row", "s").agg(
            F.sum(F.when(is_found, F.abs("n")).otherwise(0)).alias("differ"), F.max((~is_found).cast("int")).alias("left"), *(sides if keep else []))
        done = written(ends.withColumn("level", F.lit(level)), "peeled")
        found.append(done.where("left = 0").drop("left"))
        failed, level = done.where("left = 1").select("row", "s"), level + 1
    return reduce(DataFrame.unionByName, found)


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """The share of common paragraphs among all of two texts with ``a`` and ``b`` of them."""
    return F.when(a + b == 0, 1.0).otherwise((a + b - differ) / (a + b + differ))


def shown(size: Column, held_cells: Column) -> Column:
    """A sketch as text: its size, then place, count, key and check of each cell in use, all as hexadecimal numbers."""
    each = F.transform(F.sort_array(held_cells), lambda x: F.concat_ws(".", *[F.hex(x[f]) for f in ("t", "c", "n", "key", "chk")]))
    return F.lower(F.concat_ws("|", F.concat(F.array(F.hex(size)), each)))


def stored(rows: DataFrame) -> DataFrame:
    """The cells of fingerprints (row, s, fingerprint)."""
    number = lambda x: F.conv(x, 16, -10).cast("bigint")
    parts = F.split("fingerprint", "[|]")
    cell = rows.select("row", "s", number(F.element_at(parts, 1)).cast("int").alias("size"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("x"))
    at = F.split("x", "[.]")
    return cell.select("row", "s", "size", number(at[0]).cast("int").alias("t"), number(at[1]).alias("c"), number(at[2]).cast("int").alias("n"), number(at[3]).alias("key"), number(at[4]).alias("chk"))


def differences(pairs: DataFrame) -> DataFrame:
    """What two stored fingerprints tell of their texts, from rows (row, a, b) with ``row`` unique: (row, near, added, removed),
    the likeness and the digests that only a and only b hold. A null fingerprint is that of an empty text."""
    two = pairs.select("row", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(name).alias("fingerprint")) for s, name in enumerate("ab")])).alias("x"))
    one = peeled(stored(two.select("row", "x.*").where("fingerprint is not null").repartition("row")), keep=True)
    if not one.where(F.col("t") != FOUND).isEmpty():
        raise ValueError("a fingerprint doesn't peel by itself; it wasn't made here")
    keys = written(one.groupBy("row").agg(*[F.collect_list(F.when(F.col("s") == s, F.col("key"))).alias(name) for s, name in enumerate("ab")]), "stored")
    size = F.greatest(cells(F.size("a")), cells(F.size("b")))
    apart = recovered(keys.repartition("row").select("row", F.array(one_set(0, size, 1, F.col("a")), one_set(0, size, -1, F.col("b"))).alias("sets")), keep=True)
    counted = keys.select("row", F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    n = lambda name: F.coalesce(name, F.lit(0))
    empty = F.array().cast("array<bigint>")
    return pairs.select("row").join(counted, "row", "left").join(apart, "row", "left").select(
        "row", likeness(n("n_a"), n("n_b"), n("differ")).alias("near"), F.coalesce("added", empty).alias("added"), F.coalesce("removed", empty).alias("removed"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, next, own, other): every document with the text of the next one by id, the last with the first
    one's, and the paragraph digests of both, so that each text is cut into paragraphs once; ``row`` numbers the rows.

    The order is cut into buckets at rows of the table, from a sorted sample of keys. A row that opens a bucket is
    also sent, as a mark, to the bucket before, so one shuffle and one window per bucket do the whole order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text")).withColumn(
        "k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))
    n = docs.count()
    want = min(1 << BOUND_BITS, n // BUCKET_ROWS)
    first = rows.agg(F.min(F.struct("k", "h")).alias("m")).first()["m"]
    sample = lowest(rows.select("k", "h"), F.xxhash64("k", "h"), want * SAMPLE_A_BOUND, n).collect() if want > 1 else []
    keys = sorted({(r["k"], r["h"]) for r in sample})
    bounds = [b for b in keys[SAMPLE_A_BOUND // 2::SAMPLE_A_BOUND] if first and b > (first["k"], first["h"])]
    steps = max(1, len(bounds).bit_length())
    filled = bounds + [((1 << 63) - 1, (1 << 63) - 1)] * ((1 << steps) - len(bounds))
    bk, bh = (F.array(*[F.lit(b[i]).cast("bigint") for b in filled]) for i in (0, 1))
    reached = lambda at: (F.element_at(bk, at) < F.col("k")) | ((F.element_at(bk, at) == F.col("k")) & (F.element_at(bh, at) <= F.col("h")))
    # how many bounds lie at or before the row, by halving
    bucket = F.aggregate(F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]), F.lit(0), lambda low, s: F.when(reached(low + s), low + s).otherwise(low))
    bucket = F.least(bucket, F.lit(len(bounds)))
    at = F.col("bucket")
    opens = (at > 0) & (F.element_at(bk, F.greatest(at, F.lit(1))) == F.col("k")) & (F.element_at(bh, F.greatest(at, F.lit(1))) == F.col("h"))
    very_first = F.lit(False) if first is None else (F.col("k") == first["k"]) & (F.col("h") == first["h"])
    place = lambda b, order: F.struct(b.alias("b"), F.lit(order).alias("after"))
    places = F.array(place(at, 0), F.when(opens, place(at - 1, 1)), F.when(very_first, place(F.lit(len(bounds)), 2)))
    dealt = rows.withColumn("own", digests(F.col("text"))).withColumn("bucket", bucket).withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select(
        "doc_id", "k", "h", "text", "own", F.col("place.b").alias("bucket"), F.col("place.after").alias("after"))
    order = Window.partitionBy("bucket").orderBy("after", "k", "h")
    following = F.lead(F.struct("text", "own")).over(order)
    number = F.shiftleft(F.col("bucket").cast("bigint"), 32) + F.row_number().over(order)
    return dealt.withColumn("following", following).withColumn("row", number).where("after = 0").select(
        "row", "doc_id", "text", F.col("following.text").alias("next"), "own", F.col("following.own").alias("other"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half replaced by the next document's beginning), and
    their likeness to the text's: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    cut = (
        with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next"), F.lit(1), half)))
        .select("row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("new"), "other"))
    own, new, other = map(F.col, ("own", "new", "other"))
    cut = written(cut.select("*", *[F.size(x).alias(f"n_{name}") for x, name in ((own, "own"), (new, "new"), (other, "other"))]), "paragraphs")
    shape = lambda *names: F.greatest(*[cells(F.col(f"n_{x}")) for x in names]) if len(names) > 1 else cells(F.col(f"n_{names[0]}"))
    sets = F.array(one_set(0, shape("own"), 1, own), one_set(1, shape("new"), 1, new),
                   one_set(2, shape("own", "new"), 1, own), one_set(2, shape("own", "new"), -1, new),
                   one_set(3, shape("own", "other"), 1, own), one_set(3, shape("own", "other"), -1, other))
    total = cut.agg(F.sum(F.col("n_own") + F.col("n_new") + F.col("n_other"))).first()[0] or 0
    # by size, since Spark sees the digests only and not the cells that they become
    dealt = cut.repartition(max(1, min(total // TASK_DIGESTS, MOST_TASKS)), "row")
    found = recovered(dealt.select("row", sets.alias("sets")))
    of = lambda s, what: F.coalesce(F.max(F.when(F.col("s") == s, F.col(what))), F.lit(0))
    known = found.groupBy("row").agg(of(0, "level").alias("l_own"), of(1, "level").alias("l_new"), of(2, "differ").alias("d_new"), of(3, "differ").alias("d_other"))
    nil = lambda name: F.coalesce(name, F.lit(0)).cast("int")
    size_own, size_new = ((cells(F.col(f"n_{x}")) * F.pow(F.lit(2), nil(f"l_{x}"))).cast("int") for x in ("own", "new"))
    whole = dealt.join(known, "row", "left")
    sketches = sketched(whole.select("row", F.array(one_set(0, size_own, 1, own), one_set(1, size_new, 1, new)).alias("sets")))
    cell = F.struct("t", "c", "n", "key", "chk")
    prints = sketches.groupBy("row").agg(*[F.collect_list(F.when(F.col("s") == s, cell)).alias(name) for s, name in ((0, "p_own"), (1, "p_new"))])
    none = F.array().cast(prints.schema["p_own"].dataType)
    return whole.drop("own", "new", "other").join(prints, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown(size_own, F.coalesce("p_own", none)).alias("fingerprint"), shown(size_new, F.coalesce("p_new", none)).alias("edited_fingerprint"),
        likeness(F.col("n_own"), F.col("n_new"), nil("d_new")).alias("near_edited"), likeness(F.col("n_own"), F.col("n_other"), nil("d_other")).alias("near_next"))
