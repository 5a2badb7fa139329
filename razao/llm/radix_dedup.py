"""Operator 11: exact duplicates by distributed MSD radix partitioning.

All rows start in one group. Each round splits every group by its texts' next
bytes, as one aggregation over (group, bytes): a part with one row is done (a
singleton), a part whose texts end there is done (its texts are equal, byte by
byte), and any other part is a group of the next round. No text is hashed for
equality; digests are only an output column.

Texts stay where they are: a round shuffles its own bytes of the rows that are
still undecided, so no byte of a text goes through the split more than once.
The bytes taken grow from round to round (``FIRST``, then ``GROWTH`` times what
has been read, ``LARGEST`` at most), so that long common beginnings take few
rounds. A group of very many copies is pre-aggregated in every task, and the
join that tells its rows their group is one of two plain shuffles, which Spark
splits where one key is hot. Every round's result is a written table.

Defined results: a null text counts as an empty one; a null id is larger than
any other (``keep_id`` is null only if all ids of the group are); of rows that
share the smallest id one stays, the first one read; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Bytes of the first round, growth of the bytes read up to a round, and the most bytes that one round takes.
FIRST, GROWTH, LARGEST = 64, 16, 4 << 20
#: Bytes of undecided rows' numbers up to which they are broadcast; beyond that they are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 24

#: Runs of white space but a single space, which stays as it is.
RUNS = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def steps() -> Iterator[tuple[int, int]]:
    """(bytes read before, bytes of this round) of every round."""
    at, width = 0, FIRST
    while True:
        yield at, width
        at += width
        width = min(at * (GROWTH - 1), LARGEST)


def split(rows: DataFrame) -> DataFrame:
    """The rows (id, number, texts' bytes as ``text``) that aren't alone: (number, id, head, keep, size). ``head`` is the
    smallest number among the rows with an equal text, ``keep`` their smallest id, ``size`` their count."""
    done, undecided = [], None
    for at, width in steps():
        part = rows.where(F.octet_length("text") > at) if at else rows
        part = part.select("number", "id", F.substring("text", at + 1, width).alias("bytes"),
                           (F.octet_length("text") <= at + width).alias("ended"))
        if undecided is None:
            part = part.withColumn("node", F.lit(0).cast("bigint"))
        else:
            part = written(part.join(undecided, "number"), "radix-bytes")
        key = ["node", "bytes", "ended"]
        # written, so that the join below is one of two plain shuffles, in which Spark splits a hot key
        groups = written(part.groupBy(key).agg(F.min("number").alias("head"), F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
                         .where("size > 1"), "radix-groups")
        found = written(part.join(groups, key).select("number", "id", "head", "keep", "size", "ended"), "radix-rows")
        done.append(found.where("ended").drop("ended"))
        left = found.where("NOT ended").count()
        if not left:
            return reduce(DataFrame.unionByName, done)
        undecided = found.where("NOT ended").select("number", F.col("head").alias("node"))
        if left * ROW_BYTES <= BROADCAST_BYTES:
            undecided = F.broadcast(undecided)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Every row's class of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), and ``carry`` if given."""
    extra = [] if carry is None else [carry.alias("carry")]
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), docs[id_col].alias("id"),
                               normalised(docs[text_col]).cast("binary").alias("text"), *extra), "radix-texts", compression="zstd")
    found = split(rows)
    stays = found.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("head").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("stays"))
    return (rows.select("number", "id", F.sha2("text", 256).alias("text_sha256"), *(["carry"] if extra else []))
            .join(found.drop("id"), "number", "left").join(stays, "number", "left")
            .select(F.col("id").alias("doc_id"), F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                    (F.col("head").isNull() | F.coalesce("stays", F.lit(False))).alias("kept"), "text_sha256", *(["carry"] if extra else [])))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each class of equal texts, all columns as they are."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    return classes(docs, id_col, text_col, carry=whole).where("kept").select("carry.*")
