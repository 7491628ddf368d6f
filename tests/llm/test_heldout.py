"""Floors of accuracy on labelled rows that no model has learned from."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.llm import quality, queries
from tests.conftest import DATA

TABLES, LARGER = str(DATA / "sf0.01"), str(DATA / "sf0.1")
pytestmark = pytest.mark.skipif(not (DATA / "sf0.1").exists(), reason="no tables")


def read(spark, name, tables=TABLES):
    return spark.read.parquet(f"{tables}/{name}.parquet")


def test_languages(spark):
    found = queries.queries()["op5_language_id"](spark, TABLES).filter("held_out").select("doc_id", "lang_pred")
    rows = found.join(read(spark, "documents").filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) > 200 and (rows["lang"] == rows["lang_pred"]).mean() >= 0.98


def test_toxicity(spark):
    """On the larger tables: the smaller ones hold out six toxic documents, too few for an area."""
    found = queries.queries()["op7_toxicity"](spark, LARGER).filter("held_out").select("doc_id", "score", "predicted")
    rows = found.join(read(spark, "labels", LARGER).filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").toPandas()
    toxic, rank = rows["toxic"].to_numpy() == 1, rows["score"].rank().to_numpy()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert toxic.sum() >= 50 and area >= 0.85
    assert (rows["predicted"][~toxic] == 1).mean() <= 0.02  # clean documents are left alone


def test_quality(spark):
    """Two thirds of the labelled documents teach, the others test; the base is to call all of them good."""
    rows = read(spark, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(read(spark, "labels").filter("quality IS NOT NULL"), "doc_id").orderBy("doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in rows["doc_id"]])
    good = (rows["quality"] == 1).to_numpy()
    chain = quality.fit_texts(rows["text"][~held].tolist(), good[~held].tolist())
    verdict = quality.judge(chain, rows["text"][held].tolist())["kept"]
    right, base = (verdict == good[held]).mean(), max(good[held].mean(), 1 - good[held].mean())
    print(f"quality: {right:.4f} of {held.sum()}, base {base:.4f}")
    assert right >= 0.94 and right > base + 0.03
