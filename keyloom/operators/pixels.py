"""Pixel operators: runs of one colour in a row, rectangles, nearest colour of a palette, k-means palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(pixels: DataFrame, image: list[str]) -> DataFrame:
    """(image, y, x, width, color): runs of neighbouring pixels of one colour in each row."""
    line = Window.partitionBy(*image, "y", "color").orderBy("x")
    islands = pixels.withColumn("run", F.col("x") - F.row_number().over(line))
    return islands.groupBy(*image, "y", "color", "run").agg(F.min("x").alias("x"), F.count("*").alias("width")).drop("run")


def rectangles(found: DataFrame, image: list[str]) -> DataFrame:
    """(image, x, y, width, height, color): equal runs in neighbouring rows merged downwards."""
    column = Window.partitionBy(*image, "x", "width", "color").orderBy("y")
    islands = found.withColumn("stack", F.col("y") - F.row_number().over(column))
    return islands.groupBy(*image, "x", "width", "color", "stack").agg(F.min("y").alias("y"), F.count("*").alias("height")).drop("stack")


def nearest(color: Column, palette: dict[str, tuple[float, ...]]) -> Column:
    """Name of the palette's nearest colour, of equally near ones the first by name: a palette is a literal, so no join is needed."""
    far = lambda c: sum(((color[k] - F.lit(x)) * (color[k] - F.lit(x)) for k, x in enumerate(c)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(F.round(far(c), 9).alias("far"), F.lit(n).alias("name")) for n, c in sorted(palette.items())]))["name"]


def palette(colors: DataFrame, column: str, n: int, seed: int = 42) -> list[list[float]]:
    """n colours by k-means over an array column: centres only come to the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n, seed=seed).fit(colors.select(array_to_vector(F.col(column)).alias("features")))
    return sorted(c.tolist() for c in model.clusterCenters())
