"""The quality classifier: held-out accuracy, whole numbers, odd rows."""

import numpy as np
import pyarrow as pa

from keyloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.quality for r in labels]
    assert sum(right) >= 0.95 * len(right)
    good, bad = ([got[r.doc_id].score for r in labels if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).cache()
    a, b = quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(5))
    assert np.array_equal(a, b) and np.abs(a).sum() > 0


def test_tokens_and_marks():
    core, marks, per = quality.tokens(pa.array(["One one\t!!! a", None, "", " ", "a", "a"]))
    assert per.tolist() == [4, 0, 0, 0, 1, 1] and core[0] == core[1] and marks[0] != marks[1] and marks[4] == marks[5]
    assert quality.mark("WORD!!") == "upper|!!" and quality.mark("%%%") == "sign|%%%" and quality.mark("x1.") == "digit|."


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (1, "a b", 0.5), (2, None, 1.0), (None, "", None), (3, "long " * 90000, 2.0)], "doc_id long, text string, quality double")
    for labels in ([], [(1, 1), (1, None), (None, 0)], [(i, i % 2) for i in range(1, 4)]):
        out = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = out.collect()
        assert out.columns == ["doc_id", "text", "quality", "quality_score"] and len(rows) == 5
        assert all(0 <= r.quality_score <= 1 for r in rows) and len({r.quality_score for r in rows if r.doc_id == 1}) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_temperature_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.fit(x, y).score(x)
    for a, b in ((0.1, 0.3), (0.4, 0.6), (0.7, 0.9)):
        inside = (p > a) & (p < b)
        assert abs(y[inside].mean() - p[inside].mean()) < 0.08
