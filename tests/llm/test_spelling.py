"""Operator 13 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from razao.llm import queries, spelling


def apart(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def plain(rows: list[tuple]) -> list[tuple]:
    count: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and apart(w, v) == 1] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def mentions() -> list[tuple]:
    """Chains of variants with growing counts, ties, repeated letters, accents and other scripts."""
    rnd = random.Random(5)
    bag = ["letter"] * 700 + ["leter"] * 90 + ["lettter"] * 120 + ["letterr"] * 20 + ["letters"] * 30 + ["lettars"] * 5 + ["eletter"] * 5
    bag += ["Größer"] * 60 + ["grösser"] * 12 + ["GRÖßER"] * 9 + ["größers"] * 11 + ["×÷×÷×÷"] * 6 + ["×÷×÷×÷×"] * 7 + ["aaaaaa"] * 40 + ["aaaaaaa"] * 8 + ["aaaaaaaa"] * 8
    bag += ["xaaaaaa"] * 6 + ["aaaxaaa"] * 6 + ["aaaaaax"] * 6 + ["short"] * 50 + ["shorte"] * 9 + ["fivers"] * 4 + ["фывапро"] * 9
    alphabet = "abé"
    for _ in range(500):
        w = "".join(rnd.choices(alphabet, k=rnd.randrange(6, 10)))
        bag += [w] * rnd.choice([1, 5, 5, 6, 30])
    rnd.shuffle(bag)
    rows = [(i, " ".join(bag[at:at + 40])) for i, at in enumerate(range(0, len(bag), 40))]
    return rows + [(None, "letter-lettre Letter1letter " * 7), (3, None), (4, ""), (5, "a" * 3000 + " x"), (5, "a" * 3000 + " x")] + [(6, "b" * 3000)] * 5 + [(7, "b" * 3001)] * 5


@pytest.mark.parametrize("large", [4096, 2])
def test_variants_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE_GROUP", large)  # 2: every group is divided down to one code point
    monkeypatch.setattr(spelling, "KEPT", 50)
    rows = mentions()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id bigint, text string, word string, n int, form string").repartition(3)
    got = sorted(map(tuple, spelling.variants(df).collect()))
    want = plain(rows)
    assert got == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)  # a chain
    assert spelling.variants(df.where("false")).collect() == []


def test_windows_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "WINDOW", 7)
    rnd = random.Random(3)
    for _ in range(200):
        t = "".join(rnd.choices("abcdefgé  1", k=rnd.randrange(60)))
        assert "".join(spelling.windows(t)) == t
        assert spelling.mention_counts(t, 9, 6, 199) == Counter(w for p in [t] for w in re.findall("[a-zÀ-ÿ]{6,}", p) if zlib.crc32(f"9:{w}".encode()) % 199)


def test_scan_equals_all_pairs_and_skips():
    rnd = random.Random(8)
    for size in (1, 2, 3, 5, 8):
        entries = sorted({"".join(rnd.choices("abc", k=rnd.choice([size, size + 1]))) for _ in range(120)})
        asked = [i for i, e in enumerate(entries) if len(e) == size]
        want = sorted((i, j) for i in asked for j in range(len(entries)) if apart(entries[i], entries[j]) == 1)
        assert sorted(spelling.scan(entries, asked)) == want
    entries = ["abcdefgh", *sorted("zz" + "".join(rnd.choices("abc", k=7)) for _ in range(500))]
    assert list(spelling.scan(entries, [0])) == []


def test_query_types(spark):
    got = queries.op13_spelling(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
