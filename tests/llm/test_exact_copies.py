"""Operator 11 against plain grouping."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from razao.llm import queries, radix_dedup

SCHEMA = "doc_id bigint, text string, number int, head string, size int, carry int"


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, size, text digest) of every row."""
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups: dict[str, list] = {}
    for (i, _), b in zip(rows, bodies):
        groups.setdefault(b, []).append(i)
    key = lambda i: (i is None, i or 0)
    return sorted([(i, min(groups[b], key=key), len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for (i, _), b in zip(rows, bodies)], key=repr)


def rows_of_all_kinds() -> list[tuple]:
    rnd = random.Random(11)
    long = "".join(rnd.choice("ab \n") for _ in range(40_000))
    texts = [None, "", " ", "\t\n ", "a", "a ", " a", "a\x0b\x0cb", "a b", "a b", "a\x1cb", "é", "é", "x" * 64, "x" * 63, "x" * 65, "x" * 1024, "x" * 1025,
             long, long + "!", "!" + long, long.replace("\n", " \r\n"), "👩‍🚀" * 40, "👩‍🚀" * 40 + "\x00"]
    base = "".join(rnd.choice("abcdef ") for _ in range(1500))
    texts += [base[:n] + c for n in (0, 10, 63, 64, 65, 500, 1023, 1024, 1500) for c in ("", "q", " ")] + [base] * 300
    rows = list(enumerate(texts)) + list(enumerate(texts[:40], 10_000)) + [(None, "nobody"), (None, "nobody"), (None, "a b"), (7, "a\tb"), (8, "a b"), (8, "a b")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = rows_of_all_kinds()
    return rows, spark.createDataFrame([(i, t, 1, "x", 2, k) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)


@pytest.mark.parametrize("widths", [(64, 16, 4 << 20, 8 << 20), (1, 2, 100, 0), (3, 4, 5000, 8 << 20)])
def test_classes_equal_plain_grouping(made, monkeypatch, widths):
    for name, value in zip(("FIRST", "GROWTH", "LARGEST", "BROADCAST_BYTES"), widths):
        monkeypatch.setattr(radix_dedup, name, value)
    rows, df = made
    if widths[0] == 1:  # one byte at first: short texts only, each round is several Spark jobs
        rows, df = [r for r in rows if len(r[1] or "") <= 70], df.where("coalesce(length(text), 0) <= 70")
    got = radix_dedup.classes(df).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == plain(rows)
    # of every class one row stays, one with the smallest id
    kept = [r for r in got if r["kept"]]
    assert len({r["text_sha256"] for r in got}) == len(kept) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_steps_grow_and_cover():
    rounds = radix_dedup.steps()
    at = 0
    for start, width in (next(rounds) for _ in range(12)):
        assert start == at and 0 < width <= radix_dedup.LARGEST
        at += width
    assert at > 20 << 20


def test_white_space_runs_as_named(spark):
    texts = ["".join(random.Random(i).choices("a \t\n\x0b\x0c\r\x1c ", k=30)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", radix_dedup.normalised(F.col("t")).alias("n")).collect()}
    assert got == {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in enumerate(texts)}


def test_keep_one_returns_whole_rows(made):
    rows, df = made
    kept = radix_dedup.keep_one(df)
    assert kept.dtypes == df.dtypes
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


def test_empty_table(spark):
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    assert radix_dedup.classes(nothing).collect() == [] == radix_dedup.keep_one(nothing).collect()


def test_query_types(spark):
    got = queries.op11_radix_dedup(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
