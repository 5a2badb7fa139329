"""Lookups of distinct texts give what direct parsing gives, and are left out where they don't pay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from razao.rules import LEDGER_TABLE
from razao.sources import dictionary, ingest

ODD = ["", " ", None, "Março 2026", " março/26 ", "03/2026", "2026-03", "5 mar 2026", "nope", "13/13/2026", " Abril\t2026", "ﬁm", "각", "5"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(ODD[i % len(ODD)], ODD[(i // 3) % len(ODD)], ODD[(i // 5) % len(ODD)], f"only {i}", "Sim" if i % 2 else None, f"{i},5") for i in range(400)]
    return spark.createDataFrame(rows, "Mes string, Data string, Origem string, Descricao string, `Entra Custo Pessoal` string, `Valor Real Dashboard` string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookups_equal_direct_parsing(odd):
    direct = ingest.standardize(odd, LEDGER_TABLE)
    looked_up = ingest.ingest_table(odd, LEDGER_TABLE, "test/dictionary")
    landed = ingest.ingest_table(odd, LEDGER_TABLE, "test/dictionary-landed", unsplit=True)
    assert looked_up.columns == direct.columns == landed.columns
    assert looked_up.dtypes == direct.dtypes
    assert rows(looked_up) == rows(direct) == rows(landed)


def test_mostly_distinct_columns_are_parsed_directly(odd):
    prepared = ingest.prepare(odd, LEDGER_TABLE)
    lookups = ingest.learn_lookups(prepared)
    assert set(lookups) == {"mes", "data", "origem", "entra_custo_pessoal"}  # not the descriptions: each occurs once
    plan = ingest.standardize(odd, LEDGER_TABLE, lookups=lookups)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 4


def test_large_dictionaries_are_not_broadcast(odd, monkeypatch):
    monkeypatch.setattr(dictionary, "MAX_BYTES", 20)
    assert set(ingest.learn_lookups(ingest.prepare(odd, LEDGER_TABLE))) == {"entra_custo_pessoal"}
    assert rows(ingest.ingest_table(odd, LEDGER_TABLE, "test/dictionary-small")) == rows(ingest.standardize(odd, LEDGER_TABLE))


def test_empty_and_bare_tables(spark, odd):
    none = ingest.ingest_table(odd.where(F.lit(False)), LEDGER_TABLE, "test/dictionary-none")
    assert none.count() == 0 and none.columns == ingest.standardize(odd, LEDGER_TABLE).columns
    bare = spark.createDataFrame([("x", 1.5)], "Nota string, Valor double")
    assert rows(ingest.ingest_table(bare, "notes", "test/dictionary-bare")) == rows(ingest.standardize(bare, "notes"))


def test_landed_tables_are_estimated_on_the_way(spark, odd):
    about = {}
    named = ingest.standardize_headers(odd)
    kinds = ingest.looked_up_kinds(named)
    landed = ingest.land(named, "test/estimated", dictionary.estimates(kinds), about)
    assert about["rows"] == 400 and set(about) == {"rows", *(f"c{i}" for i in range(len(kinds)))}
    prepared = ingest.prepare(landed, LEDGER_TABLE)
    assert set(ingest.learn_lookups(prepared, about=about)) == set(ingest.learn_lookups(prepared))


def test_generated_methods_are_compiled(spark, demo_raw):
    """The JVM only interprets methods over 8,000 bytes: no part of the clean rows' plan has one."""
    sheet = demo_raw[LEDGER_TABLE].crossJoin(spark.range(5)).drop("id")
    raw = ingest.land(ingest.standardize_headers(sheet), "test/generated")
    clean = ingest.standardize(raw, LEDGER_TABLE, lookups=ingest.learn_lookups(ingest.prepare(raw, LEDGER_TABLE)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(clean._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the stages of the rows themselves, not those that parse the distinct texts
    stages = [s for s in text.split("== Subtree ")[1:] if "CollectMetrics" in s.partition("Generated code:")[0] or "BroadcastHashJoin" in s.partition("Generated code:")[0]]
    assert stages and all(int(s.partition("maxMethodCodeSize:")[2].partition(";")[0]) < 8000 for s in stages)
