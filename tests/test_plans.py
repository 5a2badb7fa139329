"""Plan properties: no Python in any plan, one shuffle for the monthly audit,
partition pruning on a clean table, lineage cut by materialization, no job while
a plan is built, no fixed repartitioning."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from razao.operators import filters as FL
from razao.plans import audit, marts
from razao.plans import catalogue as K
from razao.sources import ingest

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans(demo):
    tx, rev = demo["fact_transacoes"], demo["dim_meses"]
    for df in (tx, marts.cash_flow_monthly(tx, rev), marts.category_ranking(tx), audit.audit_months(tx),
               marts.receivable_detail(demo["fact_marta"]), marts.bet_ledger(tx, demo["fact_apostas_kto"])):
        p = plan(df)
        assert not any(n in p for n in PYTHON_NODES), p


def test_monthly_audit_is_one_shuffle(demo):
    tx = demo["fact_transacoes"]
    p = plan(audit.audit_months(tx))
    assert p.count("Exchange hashpartitioning(period") == 1


def test_period_filter_prunes_partitions(spark, demo):
    path = tempfile.mkdtemp(prefix="razao-clean-", dir="/tmp") + "/ledger"
    ingest.write_clean(demo["fact_transacoes"], path)
    clean = spark.read.parquet(path)
    q = FL.period_filter(clean, ["2026-02"])
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in text and "2026-02" in text
    assert q.count() == 4


def test_materialize_cuts_lineage(spark, demo):
    m = ingest.materialize(demo["fact_transacoes"], "test/ledger")
    text = plan(m)
    assert "FileScan parquet" in text and "Scan ExistingRDD" not in text
    assert m.count() == 10
    assert m.where(F.col("period") == "2026-03").count() == 3


def test_unread_columns_cost_no_parser(spark):
    text = optimized(K.QUERIES["alias_and_provenance"](spark, SF))
    assert "try_to_date" not in text and text.count("translate") < 3


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_plan_deals_rows_to_a_fixed_number_of_partitions(spark):
    for name, query in K.QUERIES.items():
        text = optimized(query(spark, SF))
        assert "Repartition" not in text, name


def test_marts_run_no_job_while_they_are_built(spark, demo):
    tx, rev, items = demo["fact_transacoes"], demo["dim_meses"], demo["fact_marta"]
    sc = spark.sparkContext
    sc.setJobGroup("building", "plans only")
    try:
        for build in (lambda: marts.cash_flow_monthly(tx, rev), lambda: marts.cash_flow_summary(tx, rev),
                      lambda: marts.category_ranking(tx), lambda: marts.category_headline(tx, rev), lambda: marts.category_evolution(tx, rev),
                      lambda: marts.item_summary(items), lambda: marts.bet_ledger(tx, demo["fact_apostas_kto"])):
            build()
        assert not sc.statusTracker().getJobIdsForGroup("building")
    finally:
        sc._jsc.sc().clearJobGroup()


def test_unused_fallback_is_tested_below_its_aggregation(demo):
    text = optimized(marts.bet_ledger(demo["fact_transacoes"], demo["fact_apostas_kto"]))
    fallback = text[text.index("Union"):]
    assert fallback.rindex("subquery") > fallback.rindex("Aggregate")


def test_period_layout_has_few_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 40).selectExpr("concat('2026-0', cast(id % 9 + 1 as string)) as period", "id")
    ingest.write_clean(rows, str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*.parquet"))
    assert len(files) <= 18 and spark.read.parquet(str(tmp_path / "out")).count() == 4000
