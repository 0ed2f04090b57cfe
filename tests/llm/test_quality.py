"""Quality classifier: held-out accuracy, and odd rows."""

import zlib

from pyspark.sql import functions as F

from aftershock.llm.quality import fit_quality, score_quality
from aftershock.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = QUERIES["op7_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 500
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.99


def test_held_out_rows(spark):
    rows = QUERIES["op7_quality"](spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (7, 0), (3, 1), (6, 5), (None, 1), (4, None)], "doc_id long, quality int")
    model = fit_quality(odd_docs, labels)
    rows = score_quality(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    whole = score_quality(odd_docs, model, odd_docs.columns)
    assert set(whole.columns) == set(odd_docs.columns) and whole.count() == len(rows)
    assert score_quality(no_docs, model).count() == 0
    again = fit_quality(odd_docs.repartition(1), labels.withColumn("text", F.lit(1)))
    assert (again.weights == model.weights).all()


def test_without_labels_nothing_is_known(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = score_quality(odd_docs, fit_quality(no_docs, labels)).collect()
    assert {r["score"] for r in rows} == {0.5}
