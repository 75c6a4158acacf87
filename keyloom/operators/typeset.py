"""Placing text, inheriting gradients, padding command rows, pruning walks, first values of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spaces that a tab is worth; the command that pads command rows.
TAB, PAD_COMMAND = 4, 28


def place_text(texts: DataFrame, key: str, text: str, advance: dict[str, float], default: float, kerning: dict[str, float] | None = None, line_height: float = 1.0) -> DataFrame:
    """(key, pos, char, x, y): where each sign of a text stands; new lines start at 0 below, tabs are TAB spaces wide.

    advance: widths of signs; kerning: by pairs of neighbouring signs, added between them. A text is placed in one
    task, by a running sum.
    """
    known = F.create_map(*[F.lit(v) for kv in (advance or {" ": default}).items() for v in kv])
    pairs = F.create_map(*[F.lit(v) for kv in (kerning or {"": 0.0}).items() for v in kv])
    signs = texts.select(key, F.posexplode(F.split(text, "")).alias("pos", "char")).where(F.col("char") != "")
    whole = Window.partitionBy(key).orderBy("pos")
    lined = signs.withColumn("line", F.coalesce(F.sum((F.col("char") == "\n").cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    line = Window.partitionBy(key, "line").orderBy("pos")
    space = F.coalesce(known[F.lit(" ")], F.lit(default))
    width = F.when(F.col("char") == "\n", 0.0).when(F.col("char") == "\t", space * TAB).otherwise(F.coalesce(known[F.col("char")], F.lit(default)))
    kern = F.coalesce(pairs[F.concat(F.lag("char").over(line), F.col("char"))], F.lit(0.0))
    wide = lined.withColumn("w", width).withColumn("k", kern)
    x = F.coalesce(F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.sum("k").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return wide.select(key, "pos", "char", x.alias("x"), (F.col("line") * line_height).alias("y")).where(F.col("char") != "\n")


def inherit_stops(gradients: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, stops array of (offset, color)): a gradient's own stops, else those of the one it refers to, in whatever order they stand.

    gradients: (id, href); stops: (id, pos, offset, color). Two steps of reference are followed.
    """
    own = stops.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "offset", "color"))), lambda s: F.struct(s["offset"].alias("offset"), s["color"].alias("color"))).alias("stops"))
    g = gradients.join(own, "id", "left")
    up = g.select(F.col("id").alias("href"), F.col("href").alias("href2"), F.col("stops").alias("stops2"))
    up2 = g.select(F.col("id").alias("href2"), F.col("stops").alias("stops3"))
    return g.join(up, "href", "left").join(up2, "href2", "left").select("id", F.coalesce("stops", "stops2", "stops3").alias("stops"))


def pad_rows(rows: DataFrame, length: int, slots: int) -> DataFrame:
    """(doc_id, pos, idx, params array): command rows filled up to `length` with the padding command; missing parameters are null."""
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    nothing = F.array_repeat(F.lit(None).cast("double"), slots)
    fill = n.where(F.col("n") < length).select("doc_id", F.explode(F.sequence(F.col("n").cast("int"), F.lit(length - 1))).alias("pos"), F.lit(PAD_COMMAND).alias("idx"), nothing.alias("params"))
    full = F.slice(F.concat("params", nothing), 1, slots)
    return rows.where(F.col("pos") < length).select("doc_id", "pos", "idx", full.alias("params")).unionByName(fill)


def prune(walk: DataFrame, stop: Column) -> DataFrame:
    """A walk (key, path, ...) without what lies below the nodes that stop it; those themselves stay.

    A node goes if one of the paths above it is a stopping one: an equi-join on the ancestors' paths.
    """
    cut = F.transform(F.split("path", r"(?=[.\[])"), lambda p: p)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(cut) - 1)), lambda n: F.array_join(F.slice(cut, F.lit(1), n), ""))
    stops = walk.where(stop).select("key", F.col("path").alias("up")).distinct()
    below = walk.where(F.size(cut) > 1).select("key", "path", F.explode(above).alias("up")).join(stops, ["key", "up"], "left_semi").select("key", "path").distinct()
    return walk.join(below, ["key", "path"], "left_anti")


def first_scalar(prop: Column, default: float) -> Column:
    """A property's (a variant's) first number: still or of its first keyframe, bare or in a list."""
    get = lambda path: F.try_variant_get(prop, path, "double")
    return F.coalesce(get("$.k[0].s[0]"), get("$.k[0].s"), get("$.k[0]"), get("$.k"), F.lit(default))


def first_vector(prop: Column) -> Column:
    """A property's first value as a vector; null if it has none."""
    get = lambda path: F.try_variant_get(prop, path, "array<double>")
    return F.coalesce(get("$.k[0].s"), get("$.k"))


def skip_batches(rows: DataFrame, batch: str, done: int) -> DataFrame:
    """What is left of an epoch after a number of batches."""
    return rows.where(F.col(batch) >= done)
