"""Operator 12 against plain cutting, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from razao.llm import fill_middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TEXTS = [None, "", " ", "a", "word", "two words", "é", "aéb", "@[`{AZaz", "<P>", "a<S>b", "x<M", "x<", "<<P", "S>M>P>", "\x00\n\r\x85", "👩‍🚀" * 30, "Z" * 50_000,
         "word 1, " * 20_000, "<P" * 500, "line\n" * 3000]


def plain(text: str | None, doc_id) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(parts[0]), len(parts[1]), "<S>" + parts[2] + "<P>" + parts[0] + "<M>" + parts[1]
    return len(units), "psm", len(parts[0]), len(parts[1]), "<P>" + parts[0] + "<S>" + parts[2] + "<M>" + parts[1]


def test_documents_equal_plain_cutting(spark):
    rows = [(i, t) for k in range(8) for i, t in enumerate(TEXTS, 1000 * k)] + [(None, "no id here"), (5, "two words"), (5, "two words")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id bigint, text string, n int, form string, output string").repartition(4)
    got = fill_middle.documents(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain(t, i), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.documents(df.where("false")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 5000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    lanes, before = fill_middle.SkipList(widths), np.r_[0, np.cumsum(widths)]
    assert [lanes.point(r) for r in range(n + 1)] == before.tolist()
    for below, above in zip(lanes.lanes, lanes.lanes[1:]):  # a node spans what the nodes below it span
        assert above[0].sum() == below[0].sum() and above[1].sum() == below[1].sum() and len(above[0]) == -(-len(below[0]) // fill_middle.FAN)


def test_descent_is_short(monkeypatch):
    steps = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            steps.append(i)
            return super().__getitem__(i)

    lanes = fill_middle.SkipList(np.ones(1 << 16, np.int64))
    lanes.lanes = [(u.view(Counted), p) for u, p in lanes.lanes]
    assert lanes.point(54_321) == 54_321 and len(steps) <= 2 * fill_middle.FAN * len(lanes.lanes)


def test_units():
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choices("abYZ@[`{é 1\n👩", k=rnd.randrange(40)))
        assert fill_middle.unit_widths(t).tolist() == [len(u) for u in UNIT.findall(t)]


def test_rates_follow_the_parameters():
    forms = [fill_middle.transform("some text here", i, seed=7, rate=50, spm=50)[1] for i in range(2000)]
    assert abs(forms.count("plain") / 2000 - 0.5) < 0.05 and abs(forms.count("spm") / 2000 - 0.25) < 0.05
    assert all(fill_middle.transform("some text", i, seed=7, rate=0, spm=50)[1] == "plain" for i in range(50))
