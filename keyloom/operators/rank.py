"""Row numbers over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, by: str, keys: tuple[str, ...] = (), name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Rank from 0 by a unique numeric column, within keys or over the table.

    Approximate quantiles cut `by` into buckets of about equal size. Rows are numbered within (keys, bucket), and each
    bucket starts where those before it end; only the counts of buckets meet in one task. The quantiles come from a
    sketch and needn't be exact: any cuts give the same ranks.
    """
    buckets = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(by))) if cuts else F.lit(0)
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(by)
    # a row for each key and bucket, a bounded number for a bounded number of keys: left to the planner all the same
    placed = dealt.withColumn("_i", F.row_number().over(inside) - 1).join(starts, [*keys, "_bucket"])
    return placed.withColumn(name, (F.col("_start") + F.col("_i")).cast("bigint")).drop("_bucket", "_i", "_start")
