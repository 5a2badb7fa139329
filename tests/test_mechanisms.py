"""Term tables, date ranges, row-grain windows, merged frames, sketches, the one-scan audit and observed counts."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from razao import schema as S
from razao.operators import aggregates as A
from razao.operators import filters as FL
from razao.operators import terms as TM
from razao.plans import audit, marts, quality
from razao.plans import catalogue as K
from razao.rules import LEDGER_TABLE, TABLE_NAMES
from razao.sources import ingest
from tests.conftest import LEDGER_HEADERS, LEDGER_ROWS, _text_frame

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# terms

TEXTS = [None, "", "a", "ab", "abc", "gas natural", "gasolina", "tv por cabo", "a.b(c)", "xx [y] \\d", "xy", "çé abc", "aaaaaaa", "gas"]
TERMS = [None, "", "a", "ab", "gas", "tv", "b(c", "[y]", "\\d", "é a", "aaa", "zzz", "abcd", "gas", "natural"]


@pytest.mark.parametrize("gram", [1, 2, 3, 6])
def test_term_table_equals_every_pair(spark, gram):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choices("abc ", k=rnd.randrange(1, 15))) for _ in range(150)]
    terms = TERMS + ["".join(rnd.choices("abc", k=rnd.randrange(1, 7))) for _ in range(60)]
    t, w = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = TM.matches(t, w, gram=gram).collect()
    want = {(x, y) for x in texts if x for y in terms if y and y in x}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    plan = executed(TM.matches(t, w, gram=gram))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_term_table_whole_words_and_empty_tables(spark):
    t = spark.createDataFrame([("gasolina",), ("o gas",), ("tv",), (None,)], "item string")
    w = spark.createDataFrame([("gas", "Gás", 1), ("tv", "TV", 3), ("o", "O", 2)], "term string, label string, place int")
    flags = lambda **k: {r.item: r.hit for r in TM.add_contains_flag(t, "item", w, "hit", **k).collect()}
    assert flags() == {"gasolina": True, "o gas": True, "tv": True, None: False}
    assert flags(whole_word=True) == {"gasolina": False, "o gas": True, "tv": True, None: False}
    assert {r.item: r.bill for r in TM.add_term_class(t, "item", w, "bill").collect()} == {"gasolina": "O", "o gas": "O", "tv": "TV", None: None}
    none = w.where("false")
    assert not any(r.hit for r in TM.add_contains_flag(t, "item", none, "hit").collect())
    assert [r.x for r in TM.add_listed_flag(t, ["item"], spark.createDataFrame([("tv",), (None,)], "term string"), "x").orderBy("item").collect()] == [False, False, False, True]


def test_term_search_reads_no_text_for_terms_of_one_word(spark):
    """Long texts full of short words: trigrams are taken of different words only, and texts aren't repeated for their terms."""
    t = spark.createDataFrame([(" ".join(["lorem", "ipsum"] * 400 + [str(i)]),) for i in range(300)] + [("a  b",), ("   ",)], "text string")
    w = spark.createDataFrame([("psu",), ("ore",), ("  ",), ("m i",), ("m  i",), (" 29",), ("\n",)], "term string")
    want = {"psu": 300, "ore": 300, "m i": 300, " 29": 11, "  ": 2}
    assert {r.term: r["count"] for r in TM.matches(t, w).groupBy("term").count().collect()} == want
    counts = TM.match_counts(t, w, "n").collect()
    assert len(counts) == 302 and sum(r.n for r in counts) == sum(want.values())


def shuffled_bytes(df) -> int:
    """Bytes of the rows that the run's shuffles wrote, subqueries left out."""
    def walk(node) -> int:
        name = node.nodeName()
        if name.startswith("Reused"):
            return 0
        below = [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return (node.metrics().apply("dataSize").value() if name == "Exchange" else 0) + sum(map(walk, below))
    df.collect()
    return walk(df._jdf.queryExecution().executedPlan().executedPlan())


def test_term_counts_shuffle_no_text(spark, tmp_path):
    """Long texts of short words: what is shuffled follows the words that can hold a term, not the texts."""
    docs = [(i, f"Of{i} " + "to be " * 8000 + f"xxlonger{i % 50} biglonger{i % 7} longer{i % 50}") for i in range(100)]
    docs += [(100, docs[0][1]), (None, docs[1][1]), (101, ""), (102, None), (103, "nothing in here")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = [("longer7 is xlonger49 xlonger49",), ("longer4 biglonger",), (None,), ("",)]
    spark.createDataFrame(terms, "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = K.QUERIES["term_table_search"](spark, str(tmp_path))
    want = [(i, n) for i, t in docs if t and (n := sum(x in t for x in ("longer7", "xlonger49", "longer4", "biglonger")))]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and (None, 1) in want
    assert shuffled_bytes(found) < sum(len(t or "") for _, t in docs) // 10


def test_inputs_are_written_without_holding_a_split(spark, monkeypatch):
    """A sort within tasks holds a whole input split of wide rows in memory."""
    from razao.plans import catalogue
    sorts, write = [], ingest.materialize
    monkeypatch.setattr(catalogue, "_PLANS", {})
    monkeypatch.setattr(ingest, "materialize", lambda df, name, partition_by=None, cluster_by=None, *rest: sorts.append(cluster_by) or write(df, f"unsorted/{name}", partition_by, cluster_by, *rest))
    assert catalogue.ledger(spark, SF).count() > 0 and sorts and not any(sorts)


# FLT-2

def test_date_range_is_pushed_and_loses_no_row(spark, tmp_path):
    by_date = ingest.standardize(spark.createDataFrame([("31/01/2026",), ("01/02/2026",), ("28/02/2026",), ("01/03/2026",), ("31/12/2026",), ("x",)], "Data string"), "t")
    by_month = ingest.standardize(spark.createDataFrame([("02/2026", "15/07/2025"), ("02/2026", None), ("03/2026", "10/02/2026")], "Mes string, Data string"), "t")
    assert by_date.first()[S.PERIOD_FROM] == "date" and S.PERIOD_FROM not in by_month.columns
    both = by_date.unionByName(by_month, allowMissingColumns=True)
    kept = FL.period_filter(both, ["2026-02"]).select(S.PERIOD, F.col("data").cast("string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([("2026-02", "2026-02-01"), ("2026-02", "2026-02-28"), ("2026-02", "2025-07-15"), ("2026-02", None)], key=repr)
    assert FL.period_filter(both, ["2026-12", "2026-01"]).count() == 2
    assert FL.period_filter(both, ["2026-02", "odd"]).count() == 4
    by_date.sortWithinPartitions("data").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = executed(FL.period_filter(spark.read.parquet(str(tmp_path / "t")), ["2026-12"]))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(data,2026-12-01)" in plan and "LessThan(data,2027-01-01)" in plan


# WIN at row grain

def test_running_rows_equal_one_pass(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, *range(9)]), i, rnd.choice([None, Decimal(rnd.randrange(-500, 500)) / 100])) for i in range(700)]
    df = spark.createDataFrame(rows, "day int, id int, value decimal(18,2)").repartition(6)
    out = A.running_rows(df, "value", ("day", "id"))
    got = {r.id: (r.running, r.previous) for r in out.collect()}
    total, before = Decimal(0), None
    for day, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        total += v or 0
        assert got[i] == (total, before), i
        before = v
    assert out.columns == ["day", "id", "value", "running", "previous"]
    assert A.running_rows(df.where("false"), "value", ("day", "id")).count() == 0
    # only the table of ranges, one row each, meets in one task
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(__range") == plan.count("windowspecdefinition(")


# JON-1, AGG-9

def test_merge_by_key_is_one_exchange(spark):
    a = spark.createDataFrame([("2026-01", Decimal(1)), ("2026-01", Decimal(2)), (None, Decimal(5))], "period string, v decimal(18,2)")
    b = spark.createDataFrame([("2026-02", 2.5)], "period string, w double")
    c = spark.createDataFrame([("2026-01", None), ("2026-03", 4)], "period string, x int")
    out = A.merge_by_key({"a": (a, "v"), "b": (b, "w"), "c": (c, "x")})
    assert executed(out).count("Exchange hashpartitioning") == 1
    assert sorted((r.period, float(r.a), float(r.b), float(r.c)) for r in out.collect()) == [("2026-01", 3, 0, 0), ("2026-02", 0, 2.5, 0), ("2026-03", 0, 0, 4)]


def test_sketches_merge(spark):
    df = spark.range(60_000).select(F.concat(F.lit("m"), F.col("id") % 3).alias("period"), F.concat(F.lit("item"), F.col("id") % 20_000).alias("item"))
    sketches = A.distinct_sketches(df.union(df.select(F.lit("m0"), F.lit(None))), "period", "item")
    assert sketches.count() == 3
    assert abs(A.distinct_estimate(sketches).first()[0] / 20_000 - 1) < 0.02
    assert abs(A.distinct_estimate(sketches.where("period <> 'm1'")).first()[0] / 20_000 - 1) < 0.02
    assert A.distinct_estimate(sketches.where("false")).first()[0] == 0


# MRT-12, DQ

def test_audit_pack_from_one_scan(demo):
    tx = demo["fact_transacoes"]
    pack = audit.audit_pack(tx)
    alone = {"summary": audit.audit_summary(tx), "exclusions": audit.audit_exclusions(tx), "months": audit.audit_months(tx),
             "categories": audit.audit_categories(tx), "sources": audit.audit_sources(tx)}
    for name, table in alone.items():
        assert pack[name].columns == table.columns
        assert list(map(tuple, pack[name].collect())) == list(map(tuple, table.collect())), name  # in order


def test_audit_cube_scans_once(spark):
    plan = executed(K.QUERIES["audit_pack"](spark, SF))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_observed_counts_give_the_report(spark):
    raw = _text_frame(spark, LEDGER_HEADERS, [*LEDGER_ROWS, ("?", "", "x", "y", " ", "z", "", "", "Sim", "")])
    counts: dict = {}
    df = ingest.ingest_table(raw, LEDGER_TABLE, "test/observed", checks=quality.row_checks, into=counts)
    assert counts == {"rows": 11, "total_lines": 1, "no_month": 1, "no_amount": 1, "blank_category": 1}
    book, known = {LEDGER_TABLE: df}, {LEDGER_TABLE: counts}
    scanned, told = quality.quality_issues(spark, book, TABLE_NAMES), quality.quality_issues(spark, book, TABLE_NAMES, checks=known)
    assert scanned.collect() == told.collect()
    assert quality.table_inventory(spark, book, TABLE_NAMES).collect() == quality.table_inventory(spark, book, TABLE_NAMES, known).collect()
    assert "FileScan" in executed(scanned) and "FileScan" not in executed(told)


# order

def test_rows_come_in_their_order(spark, demo):
    items = demo["fact_marta"]
    rows = marts.receivable_view(items, ordered=True).collect()
    assert [(r.period, r.group, r.type_order, r.item) for r in rows] == sorted((r.period, r.group, r.type_order, r.item) for r in rows)
    statement = marts.receivable_statement(items, ordered=True).collect()
    keys = [(r.period, r.row_order, r.item) for r in statement]
    assert keys == sorted(keys) and [r.row_order for r in statement].count(2) == 3
    assert "rangepartitioning" not in executed(marts.receivable_view(items)) + executed(marts.receivable_statement(items))
    assert sorted(map(tuple, marts.receivable_view(items).collect())) == sorted(map(tuple, rows))


def test_sorts_put_null_last_both_ways(spark):
    from razao.functions.nulls import asc_last, desc_last

    df = spark.createDataFrame([(2,), (None,), (1,), (3,)], "v int")
    assert [r.v for r in df.orderBy(asc_last("v")).collect()] == [1, 2, 3, None]
    assert [r.v for r in df.orderBy(desc_last("v")).collect()] == [3, 2, 1, None]
    out = A.group_count_sum(spark.createDataFrame([("b", 1), ("a", 1), ("c", 9), ("d", None)], "k string, v int"), "k", "v")
    assert [r.k for r in out.collect()] == ["c", "a", "b", "d"]
    places = spark.createDataFrame([("x",), ("second",), ("first",), (None,)], "k string").orderBy(A.rank_of(F.col("k"), ("first", "second")), desc_last("k"))
    assert [r.k for r in places.collect()] == ["first", "second", "x", None]
