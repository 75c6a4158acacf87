"""Pruned walks, first values, skipped batches."""

from pyspark.sql import functions as F

from keyloom.operators import documents, typeset


def test_prune(spark):
    docs = spark.createDataFrame([(1, '{"a": {"stop": {"x": [1]}, "b": 2}, "stop": 3, "stops": {"y": 1}}')], "id long, text string")
    walk = documents.walk(docs, "id", "text")
    left = {r.path for r in typeset.prune(walk, F.col("path").endswith(".stop")).collect()}
    assert left == {"$", "$.a", "$.a.stop", "$.a.b", "$.stop", "$.stops", "$.stops.y"}


def test_first_values(spark):
    rows = [("still", '{"a":0,"k":5}'), ("list", '{"k":[1,2]}'), ("moving", '{"a":1,"k":[{"t":0,"s":[7,8]},{"t":1}]}'), ("none", "{}")]
    df = spark.createDataFrame(rows, "n string, p string").select("n", F.parse_json("p").alias("v"))
    got = {r.n: (r.a, r.b) for r in df.select("n", typeset.first_scalar(F.col("v"), -1.0).alias("a"), typeset.first_vector(F.col("v")).alias("b")).collect()}
    assert got == {"still": (5.0, None), "list": (1.0, [1.0, 2.0]), "moving": (7.0, [7.0, 8.0]), "none": (-1.0, None)}


def test_skip(spark):
    assert typeset.skip_batches(spark.range(10), "id", 4).count() == 6
