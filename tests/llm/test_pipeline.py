"""The pipeline against its operators' plain counterparts, stage by stage."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from barlume.llm import bpe, quality, toxicity
from tests.conftest import DATA
from tests.llm.test_jaccard import components

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("replica", F.lit("own"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = docs
    chain, model = quality.fit(docs, labels), toxicity.fit(docs, labels)
    kept = dict(zip(rows, quality.judge(chain, list(rows.values()))["kept"], strict=True))
    clean = dict(zip(rows, toxicity.score_texts(model, list(rows.values())) < 0.5, strict=True))
    for name, stage in P.STAGES[:2]:
        out = stage(spark, out, str(SF))
        assert out.columns == docs.columns, name
    good = [i for i in rows if kept[i] and clean[i]]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(good)
    out = P.near_duplicates(spark, out, str(SF))
    roots = {c for _, c in components([(i, rows[i]) for i in good], 5, 80, 100).values()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(roots) and out.columns == docs.columns
    mixed = P.source_mixing(spark, out, str(SF))
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= roots
    coded = P.tokens(spark, mixed, str(SF)).collect()
    assert len(coded) == mixed.count()
    encoder = bpe.Encoder(bpe.load())
    assert all(encoder.encode([rows[r["doc_id"]] or ""])[0].tolist() == r["ids"] for r in coded[:50])
    assert P.run(spark, str(SF)).count() == len(P.run(spark, str(SF)).collect())


def test_edge_cases(spark, docs, none, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns, an empty table: through all stages."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    for k, table in enumerate((docs, none)):
        table.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        out = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, stage in P.STAGES[:4]:
            out = stage(spark, out, f"{tmp_path}/{k}")
            assert out.columns == docs.columns, name
        coded = P.run(spark, f"{tmp_path}/{k}").collect()
        assert len(coded) == out.count() and (len(coded) > 0) == (k == 0)
        encoder, texts = bpe.Encoder(bpe.load()), [r["text"] for r in docs.collect() if r["text"]]
        assert {tuple(r["ids"]) for r in coded} <= {tuple(encoder.encode([t])[0].tolist()) for t in texts}


def test_row_groups_between_stages(spark, tmp_path, monkeypatch):
    """A stage's texts are written in small row groups, as a task holds one that it reads and one that it writes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    monkeypatch.setattr(P, "ROW_GROUP", 1 << 16)
    try:
        P.quality_rules(spark, docs, str(SF)).write.parquet(f"{tmp_path}/0")
        (part,) = glob.glob(f"{tmp_path}/0/*.parquet")
        held = pq.ParquetFile(part)
        assert held.num_row_groups > 1 and held.metadata.num_rows > 100
        spark.conf.set(P.ROW_GROUP_KEY, str(128 << 20))  # what the caller sets holds
        P.quality_rules(spark, docs, str(SF)).write.parquet(f"{tmp_path}/1")
        assert spark.conf.get(P.ROW_GROUP_KEY) == str(128 << 20)
    finally:
        spark.conf.unset(P.ROW_GROUP_KEY)
    P.run(spark, str(SF))
    assert spark.conf.get(P.ROW_GROUP_KEY, None) is None
