"""Operator 13: spelling variants, by dynamic programming along sorted lists.

Words are counted over all texts. Two words are near if one inserted, deleted or
replaced code point turns one into the other. To find all such pairs without
comparing everything, words are grouped so that each pair meets in exactly one
group: with c the shorter word's length, the edit lies either behind the first
c // 2 code points, which the two then share, or before the last c - c // 2,
which they share. A group that is still large is divided again in the same way
over the part that is not known to be shared, until that part is one code point
long, so no group is unbounded whatever the vocabulary.

Within a group the parts not known to be shared are sorted and scanned once for
all of the group's words of length c together: rows of the edit matrix, three
diagonals wide, are kept by depth, the next entry starts from the row at its
common prefix with the one before, and words whose whole row exceeds one edit
are dropped there. Where none is left, all entries that share that prefix are
skipped.

Every word then points at its near word of largest count if that count is large
enough; pointer jumps over written tables lead to the roots.

Defined results: a null text has no words; a null id is taken as an empty one in
the deletion rule; repeated rows count again; an empty table gives no words;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Code points of a text that are searched at a time, and distinct words that a task counts before it hands them on.
WINDOW, KEPT = 1 << 20, 1 << 18
#: Words of a group beyond which it is divided further.
LARGE_GROUP = 4096


def windows(text: str) -> Iterator[str]:
    """The text in pieces that cut no run."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        more = RUN.match(text, end) if end < len(text) else None
        end = more.end() if more else end
        yield text[at:end]
        at = end


def mention_counts(text: str | None, doc_id, least: int, modulus: int) -> Counter:
    """The words of one text with their counts; a run whose checksum ``modulus`` divides loses one code point."""
    found: Counter = Counter()
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs = re.compile(f"{RUN.pattern[:-1]}{{{least},}}")
    for part in windows((text or "").encode().lower().decode()):  # on bytes: A-Z only
        for word, n in Counter(runs.findall(part)).items():
            h = zlib.crc32(word.encode(), base)
            if h % modulus == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
            found[word] += n
    return found


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points and ``least_count`` occurrences; summed in each task first."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def batch(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches, "text"):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in mention_counts(t, i, least_length, modulus).items():
                    total[word] += n
                if len(total) > KEPT:
                    yield batch(total)
                    total.clear()
        yield batch(total)

    sums = src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return written(sums.where(F.col("n") >= least_count), "vocabulary")


#: A group: the shorter length, the code points known to be shared at either end and their text, and the length
#: of the prefix that a pair of this group must not share, since it then meets in another (0: none).
GROUP = ["c", "head", "tail", "first", "last", "apart"]


def group(c: Column, head: Column, tail: Column, apart: Column) -> Column:
    word = F.col("word")
    return F.struct(c.alias("c"), head.alias("head"), tail.alias("tail"), F.substring(word, F.lit(1), head).alias("first"),
                    F.substring(word, F.char_length(word) - tail + 1, tail).alias("last"), apart.alias("apart"))


def halves(c: Column, head: Column, tail: Column, apart: Column) -> Column:
    """The two groups that a word of a group is in when it is divided."""
    between = c - head - tail
    h = F.floor(between / 2).cast("int")
    return F.array(group(c, head + h, tail, apart), group(c, head, tail + between - h, head + h))


def groups(words: DataFrame, least_length: int) -> DataFrame:
    """Rows (GROUP columns, word, n), in which any two near words meet in one group."""
    length, none = F.char_length("word"), F.lit(0)
    lengths = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).where(F.col("c") >= least_length)
    rows = lengths.select("word", "n", F.explode(halves(F.col("c"), none, none, none)).alias("g")).select("g.*", "word", "n")
    done = []
    while True:
        rows = written(rows, "spelling-groups")
        large = written(rows.where(F.col("c") - F.col("head") - F.col("tail") > 1).groupBy(GROUP).count()
                        .where(F.col("count") > LARGE_GROUP).select(GROUP), "spelling-large")
        if large.isEmpty():
            for other in done:
                rows = rows.unionByName(other)
            return rows
        done.append(rows.join(large, GROUP, "left_anti").select(*GROUP, "word", "n"))
        again = rows.join(large, GROUP).select("word", "n", F.explode(halves(*map(F.col, ("c", "head", "tail", "apart")))).alias("g"))
        rows = again.select("g.*", "word", "n")


FAR = 9


def scan(entries: list[str], asked: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs (position of an asked entry, position of another entry) exactly one edit apart. ``entries`` are sorted;
    those in ``asked`` have one length, the others that or one more."""
    size = len(entries[asked[0]])
    points = np.zeros((len(asked), size + 3), np.uint32)  # entry's code points at 1 to size, zero around
    for row, at in enumerate(asked):
        points[row, 1:size + 1] = np.frombuffer(entries[at].encode("utf-32-le"), "<u4")
    start = np.tile(np.array([FAR, 0, 1], np.int8), (len(asked), 1))
    if not size:
        start[:, 2] = FAR
    stack = [(np.arange(len(asked)), start)]  # by depth: the words still within one edit, and their rows
    before = ""
    for place, entry in enumerate(entries):
        common = 0
        for x, y in zip(before, entry):
            if x != y:
                break
            common += 1
        before = entry
        if common >= len(stack):  # none was within one edit of the prefix that this entry shares
            continue
        del stack[common + 1:]
        for depth in range(common + 1, len(entry) + 1):
            who, row = stack[-1]
            code = ord(entry[depth - 1])
            cost = points[who, depth - 1:depth + 2] != code if depth <= size + 1 else np.ones((len(who), 3), bool)
            new = np.empty_like(row)
            new[:, 0] = np.minimum(row[:, 0] + cost[:, 0], row[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(row[:, 1] + cost[:, 1], row[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(row[:, 2] + cost[:, 2], new[:, 1] + 1)
            if depth + 1 > size:  # no column of the matrix beyond the word's end
                new[:, max(0, size - depth + 2):] = FAR
            near = new.min(1) <= 1
            if not near.any():
                break
            stack.append((who[near], new[near]))
        else:
            who, row = stack[-1]
            diagonal = size - len(entry) + 1
            if 0 <= diagonal <= 2 and len(stack) == len(entry) + 1:
                yield from ((asked[i], place) for i in who[row[:, diagonal] == 1])


def pairs(words: DataFrame, least_length: int = 6) -> DataFrame:
    """(word, n, other, other_n): every two near words, both ways, each once."""
    dealt = groups(words, least_length).withColumn(
        "part", F.expr("substring(word, head + 1, char_length(word) - head - tail)"))
    dealt = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "part")

    def met(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        c, apart = key[0], key[5]
        asked = [i for i, r in enumerate(rows) if len(r[0]) == c]
        if not asked or len(rows) < 2:
            return
        for i, j in scan([r[2] for r in rows], asked):
            (a, n, _), (b, m, _) = rows[i], rows[j]
            if apart and a[:apart] == b[:apart]:
                continue
            yield a, n, b, m
            if len(b) > c:
                yield b, m, a, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2)], names=["word", "n", "other", "other_n"])

        key, rows, found = None, [], []
        for b in batches:
            names = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in GROUP))
            for k, r in zip(names, zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("word", "n", "part")))):
                if k != key:
                    if len(rows) > 1:
                        found.extend(met(key, rows))
                    key, rows = k, []
                    if len(found) > KEPT:
                        yield out(found)
                        found = []
                rows.append(r)
        if len(rows) > 1:
            found.extend(met(key, rows))
        yield out(found)

    return dealt.mapInArrow(run, "word string, n bigint, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; each round jumps twice as far."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = written(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, modulus: int = 199,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word's spelling group: (word, form, root, n, n_near, form_n)."""
    words = vocabulary(docs, least_length, least_count, modulus, id_col, text_col)
    best = pairs(words, least_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other"))).alias("best"))
    rows = words.join(best, "word", "left")
    large = -F.col("best.neg") >= ratio * F.col("n")
    rows = written(rows.select("word", F.when(large, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                               F.when(large, -F.col("best.neg")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
