"""Writing drawings and reports: JSON lines, gzip, HTML pages, event logs, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_filename

PAGE = '<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{title}</title></head>\n<body><div id="drawing"></div>\n<script type="application/json" id="data">{data}</script></body></html>\n'


def write_json(docs: DataFrame, text: str, path: str, gzip: bool = False) -> None:
    """A document to a line."""
    docs.select(F.col(text).alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def html_page(title: Column, data: Column) -> Column:
    """A page that holds a document; what could end its script or title is escaped."""
    safe = F.replace(data, F.lit("</"), F.lit("<\\/"))
    plain = F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head, rest = PAGE.split("{title}")
    middle, tail = rest.split("{data}")
    return F.concat(F.lit(head), plain, F.lit(middle), safe, F.lit(tail))


def unique_names(docs: DataFrame, name: str, order: str) -> DataFrame:
    """docs with file_name: names made safe; of equal ones all but the first get a number."""
    safe = docs.withColumn("file_name", sanitize_filename(F.col(name)))
    k = F.row_number().over(Window.partitionBy("file_name").orderBy(order))
    return safe.withColumn("_k", k).withColumn("file_name", F.when(F.col("_k") > 1, F.concat_ws("_", "file_name", "_k")).otherwise(F.col("file_name"))).drop("_k")


def append_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines after those that are there."""
    events.write.mode("append").json(path)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, path, left, right): leaves of two walks (key, path, value) that differ or stand on one side only."""
    a, b = (d.select("key", "path", F.col("value").alias(n)) for d, n in ((left, "left"), (right, "right")))
    return a.join(b, ["key", "path"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
