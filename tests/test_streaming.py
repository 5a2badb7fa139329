"""The standardize job on a stream of export files gives the batch result, over restarts too."""

from __future__ import annotations

import csv
import os

import pytest
from pyspark.sql import functions as F

from razao.session import ensure_checkpoint_dir
from razao.sources import ingest
from razao.streaming import incremental
from tests.conftest import LEDGER_HEADERS, LEDGER_ROWS


def _write_csv(folder, name, rows):
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(LEDGER_HEADERS)
        w.writerows(rows)


def _run(spark, src, out, checkpoint):
    stream = incremental.read_exports(spark, str(src), LEDGER_HEADERS, "fact_transacoes", max_files_per_trigger=1)
    query = incremental.write_clean_stream(stream, str(out), str(checkpoint), available_now=True)
    assert query.awaitTermination(120)


def test_restarted_stream_takes_every_file_once(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    src.mkdir()
    _write_csv(src, "part-1.csv", LEDGER_ROWS[:5])
    _run(spark, src, out, checkpoint)
    assert spark.read.parquet(str(out)).count() == 5
    _write_csv(src, "part-2.csv", LEDGER_ROWS[5:])
    _run(spark.newSession(), src, out, checkpoint)
    _run(spark.newSession(), src, out, checkpoint)
    clean = spark.read.parquet(str(out))
    assert clean.count() == 10
    kept = clean.where(F.col("is_personal_cost")).agg(F.sum("valor_real_dashboard")).first()[0]
    assert float(kept) == 3910.0
    assert sorted(r[0] for r in clean.select("period").distinct().collect()) == ["2026-01", "2026-02", "2026-03"]


ODD_CELLS = ['he said "hi", ok', "line1\nline2", '"', '",\n"a","b"', "back\\slash", "  plain "]


def test_odd_cells_over_restarts_equal_batch(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    src.mkdir()
    headers = ["Descrição", "Valor", "Mês"]
    for i, cells in enumerate((ODD_CELLS[:2], ODD_CELLS[2:4], ODD_CELLS[4:])):
        with open(src / f"part-{i}.csv", "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh)
            w.writerow(headers)
            w.writerows([c, f"{i + 1}0", "01/2026"] for c in cells)
        session = spark.newSession()
        stream = incremental.read_exports(session, str(src), headers, "fact_aluguel", multi_line=True)
        assert incremental.write_clean_stream(stream, str(out), str(checkpoint), available_now=True).awaitTermination(120)
    batch = ingest.read_workbook(spark, str(tmp_path), names=["in"], multi_line=True)["in"].drop("aba_origem", "source_table")
    streamed = spark.read.parquet(str(out))
    columns = [c for c in batch.columns if c in streamed.columns]
    assert {"descricao", "valor", "period"} <= set(columns)
    assert sorted(map(tuple, streamed.select(columns).collect()), key=repr) == sorted(map(tuple, batch.select(columns).collect()), key=repr)
    assert sorted(r.descricao for r in streamed.collect()) == sorted(ODD_CELLS)


def test_foreign_output_is_refused(spark, tmp_path):
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    src.mkdir()
    _write_csv(src, "part-1.csv", LEDGER_ROWS[:5])
    _run(spark, src, out, checkpoint)
    with pytest.raises(ValueError, match="another stream"):
        _run(spark, src, out, tmp_path / "new-progress")  # as after a lost checkpoint: batch 0 would be replaced
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no stream"):
        _run(spark, src, tmp_path / "other", tmp_path / "third")
    _run(spark, src, out, checkpoint)
    assert spark.read.parquet(str(out)).count() == 5


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
