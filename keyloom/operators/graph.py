"""Layer graphs: parents, assets, mattes, ancestors, removal with children, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut


def parent_of(layers: DataFrame) -> DataFrame:
    """layers (doc_id, ind, parent, pos) with the first layer that has the parent's index, and the parent if there is one."""
    first = layers.groupBy("doc_id", "ind").agg(F.min("pos").alias("parent_pos")).withColumnRenamed("ind", "parent")
    return layers.join(first, ["doc_id", "parent"], "left").withColumn("kept_parent", F.when(F.col("parent_pos").isNotNull(), F.col("parent")))


def asset_of(layers: DataFrame, assets: DataFrame, ref: str, key: str, value: str, name: str) -> DataFrame:
    """layers with the (smallest) value of the asset they refer to."""
    one = assets.groupBy(F.col(key).alias(ref)).agg(F.min(value).alias(name))
    return layers.join(one, ref, "left")


def matte_source(layers: DataFrame, doc: str, pos: str, ind: str, matted: Column) -> DataFrame:
    """The sibling before a matted layer."""
    before = F.lag(ind).over(Window.partitionBy(doc).orderBy(pos))
    return layers.withColumn("matte", F.when(matted, before))


def ancestor_sums(layers: DataFrame, value: str) -> DataFrame:
    """(doc, ind, depth, value): the number and the sum of a layer and its ancestors, by pointer doubling.

    Each round doubles the distance that a layer sees, so a chain of n layers takes log2 n joins, not n; rounds
    are checkpointed, so that each plans one join. A layer whose parent isn't there is a root; a cycle ends after as many
    rounds as its document's layers can need.
    """
    state = layers.select("doc", "ind", F.col("parent").alias("up"), F.lit(1).alias("depth"), F.col(value).alias(value))
    longest = layers.groupBy("doc").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (longest - 1).bit_length())):
        state = cut(state)
        above = state.select("doc", F.col("ind").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col(value).alias("value2"))
        both = state.join(above, ["doc", "up"], "left")
        state = both.select("doc", "ind", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col(value) + F.coalesce("value2", F.lit(0))).alias(value))
    return state.select("doc", "ind", "depth", F.col(value).cast("bigint").alias(value))


def delete_with_children(layers: DataFrame, gone: DataFrame) -> DataFrame:
    """layers (doc, ind, parent) without those in gone and all below them: a layer goes if some ancestor does."""
    marked = layers.join(gone.select("doc", "ind", F.lit(1).alias("bad")), ["doc", "ind"], "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    return layers.join(ancestor_sums(marked, "bad").where("bad = 0").select("doc", "ind"), ["doc", "ind"], "left_semi")


def bounding_box(points: DataFrame, group: list[str]) -> DataFrame:
    """Least and greatest x and y of each group."""
    return points.groupBy(*group).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
