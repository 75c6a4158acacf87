"""Task views of training rows: derivation, expansion, ratio resampling, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import global_rank

#: The views in their order, the ratios where losses are missing, floor and exponent of the adaptive ratios.
VIEWS = ("text", "image", "video")
FALLBACK_RATIOS = {"text": 1.0, "image": 1.2, "video": 1.4}
#: What labels call the thing that is made, a parameter. What it is made from, and the view that this is.
TARGET = "drawing"
SOURCES = {"text": "text", "text-image": "image", "video": "video"}
RATIO_FLOOR, RATIO_EXPONENT, LEAST_LOSS = 0.25, 1.0, 1e-6


def first_present(*columns: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def normalize_task(label: Column, target: str = TARGET) -> Column:
    """Labels such as ` Text_Image-to-<target> `, `video2<target>` and `text` by their view; null means text; others in lower case with hyphens."""
    plain = F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-"))
    alias = {f"{source}{joint}{target}": view for source, view in SOURCES.items() for joint in ("-to-", "2")}
    known = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    return F.when(label.isNull(), F.lit("text")).otherwise(F.coalesce(F.try_element_at(known, plain), plain))


def available_views(detail: Column, image: Column, video: Column, target: Column, task: Column) -> Column:
    """Views that a row supports. An explicit label keeps its own view alone; mixed and unknown labels keep all."""
    has_text = detail.isNotNull() & (detail != "")
    can = {"text": has_text & target.isNotNull(), "image": has_text & image.isNotNull() & target.isNotNull(), "video": video.isNotNull() & target.isNotNull()}
    label = normalize_task(task)
    return F.array_compact(F.array(*[F.when(can[v] & (~label.isin(*VIEWS) | (label == v)), F.lit(v)) for v in VIEWS]))


def explode_views(samples: DataFrame, key: str) -> DataFrame:
    """(key, view) for every view of every row."""
    c = F.col
    return samples.select(key, F.explode(available_views(c("detail"), c("image"), c("video"), c("target"), c("task_type"))).alias("view"))


def histogram(views: DataFrame) -> DataFrame:
    """Rows of each view, zero for those without any."""
    dim = views.sparkSession.createDataFrame([(v,) for v in VIEWS], "view string")
    return dim.join(views.groupBy("view").agg(F.count("*").alias("n")), "view", "left").select("view", F.coalesce("n", F.lit(0)).alias("n"))


def ratio_resample(views: DataFrame, key: str, ratios: dict[str, float]) -> DataFrame:
    """(view, key, reps): how often cyclic repetition draws each row for its view to get its share of all rows.

    A view's share is its ratio over the sum of all ratios, those of empty views included, and one row at least;
    views with a ratio of zero give nothing. Rounding is half to even.
    """
    total = sum(ratios.values())
    if min(ratios.values()) < 0 or total <= 0:
        raise ValueError("ratios must not be negative, and one must be positive")
    wanted = {v: r for v, r in ratios.items() if r > 0}
    counted = views.where(F.col("view").isin(*wanted)).groupBy("view").agg(F.count("*").alias("pool"))
    whole = views.agg(F.count("*").alias("total"))
    share = F.create_map(*[F.lit(x) for v, r in wanted.items() for x in (v, r / total)])
    need = counted.crossJoin(F.broadcast(whole)).withColumn("need", F.greatest(F.lit(1), F.bround(F.col("total") * share[F.col("view")], 0).cast("int")))
    ranked = global_rank(views.where(F.col("view").isin(*wanted)), key, ("view",), "i")
    drawn = ranked.join(F.broadcast(need), "view").where("i < need")  # a row for each view
    return drawn.select("view", key, F.ceil((F.col("need") - F.col("i")) / F.col("pool")).cast("int").alias("reps"))


def mixed_views(views: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(key, view, n): every drawn row brings all of its views along each time it is drawn."""
    times = drawn.groupBy(key).agg(F.sum("reps").alias("times"))
    return views.join(times, key).select(key, "view", F.col("times").cast("bigint").alias("n"))


def parse_ratios(text: Column) -> Column:
    """`text=1,image=1.2` as a map by normalised view."""
    return F.transform_values(F.transform_keys(F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("=")), lambda k, v: normalize_task(k)), lambda k, v: v.cast("double"))


def adaptive_ratio(loss: Column, complete: Column, view: Column) -> Column:
    """Ratio of a view by its best loss; the fixed ratios if some view has none."""
    by_loss = F.lit(RATIO_FLOOR) + F.pow(F.greatest(loss, F.lit(LEAST_LOSS)), F.lit(RATIO_EXPONENT))
    fixed = F.create_map(*[F.lit(x) for kv in FALLBACK_RATIOS.items() for x in kv])
    return F.when(complete, by_loss).otherwise(fixed[view])


def next_valid(rows: DataFrame, idx: str, ok: str, tries: int = 16, run: int = 1 << 16) -> DataFrame:
    """(idx, chosen): the first valid row among each row and those after it, `tries` in all, around the end; else null.

    idx counts rows from 0 without gaps. Runs of idx are looked through apart; each also gets the first rows of the next.
    """
    from pyspark.sql import Window

    n = rows.count()
    flags = rows.select(F.col(idx).alias("i"), F.when(F.col(ok), F.col(idx)).alias("good"))
    around = flags.where(F.col("i") < min(tries - 1, n)).select((F.col("i") + n).alias("i"), "good") if n else flags.limit(0)
    more = flags.unionByName(around)
    last = F.floor(F.lit(max(n - 1, 0)) / run)
    own = F.floor(F.col("i") / run)
    home = F.when(F.col("i") < n, own).otherwise(last)
    also = F.when((F.col("i") % run < tries - 1) & (own > 0) & (F.col("i") < n), F.array(home, own - 1)).otherwise(F.array(home))
    dealt = more.select("i", "good", F.explode(also).alias("run"))
    ahead = Window.partitionBy("run").orderBy("i").rowsBetween(0, tries - 1)
    found = dealt.withColumn("chosen", F.first("good", ignorenulls=True).over(ahead))
    return found.where((F.col("i") < n) & (F.floor(F.col("i") / run) == F.col("run"))).select(F.col("i").alias(idx), "chosen")
