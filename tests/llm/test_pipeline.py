"""The corpus pipeline over a small table, stage by stage, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from razao.llm import packing, queries, secret_scan, simhash

from .test_plain_versions import gathered, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_stages_in_order(stages, spark):
    assert list(stages) == ["language", "quality", "near_duplicates", "secrets", "packing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(after.dtypes == columns for _, after in list(stages.values())[:-1])


def test_clean_documents_stay(stages, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = stages["language"]
    assert after.count() >= 0.99 * before.count()
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in after.collect()}
    good = [r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 1]
    low = [r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in low) <= 0.2 * len(low)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    parts = plain_components([plain_fingerprint(t) for _, t in rows], 2)
    assert sorted(r["doc_id"] for r in after.collect()) == [rows[i][0] for i in sorted(set(parts))]


def test_near_duplicate_stage_gathers_no_probes(spark, monkeypatch):
    """What the stage writes is looked at before it runs: none of it sends exploded rows to the driver to be broadcast."""
    found, write = {}, simhash.written

    def looked_at(df, name):
        found[name] = [x for x in gathered(df) if "Generate explode" in x]
        return write(df, name)
    monkeypatch.setattr(simhash, "written", looked_at)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < corpus_pipeline.near_duplicates(spark, docs, SF).count() <= docs.count()
    assert "links" in found and not any(found.values())


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    new = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        spans = secret_scan.find(r["text"])[1]
        assert new[r["doc_id"]]["text"] == secret_scan.masked(r["text"], spans, "[SECRET]")
        assert new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])


def test_every_token_is_packed_once(stages):
    before, after = stages["packing"]
    path = queries.tokenizer("word_bpe_49k.json")
    want = {r["doc_id"]: len(x) // 4 for r in before.collect() for x in packing.encode(path, [r["text"]])}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_takes_odd_rows(spark, tmp_path):
    rnd = random.Random(1)
    words = "the of and to in that is was for with".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40)), "en", "s", None) for i in range(60)]
    rows += [(60, None, "en", "s", 0), (61, "", None, None, None), (None, " ".join(words), "en", "s", 1), (62, rows[0][1], "en", "s", 1), (62, rows[0][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in got and 62 not in got and not got & {60, 61} and np.isin(list(range(1, 60)), list(got)).mean() > 0.9
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
