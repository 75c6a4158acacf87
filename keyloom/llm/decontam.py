"""Benchmark decontamination (operator 7): SimHash of item-sized windows, DataFrame functions only.

An item of n words is compared with windows of n words, as multisets of 5-word shingles. Fewer than `least` hits, places
in a window whose shingle some item of n words has, leave a window below the threshold whatever else it holds; so
windows start at hits, and only where enough follow. Those windows get SimHash fingerprints, as the items do.

Fingerprints of windows at the threshold differ from their item's in 10 of 64 bits on average, and in RADIUS at most but for
one in a million. Blocks of bits can't separate strangers at so wide a radius (8 blocks of 8 bits within 2 flips, which find
all of them, let 71 % of strangers meet). So the buckets of the index are anchors: an item's rarest shingles, as many that a window
at the threshold has one of them at least. What meets under an anchor and lies within RADIUS bits is verified by weighted
shingle similarity, once for a window and an item, under the first anchor they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, columns_or_null, literal_rows
from .licenses import lower_ascii

WIDTH, THRESHOLD = 5, 0.8
#: Bits in which fingerprints of a window and its item may differ.
RADIUS = 23
#: Rows that are broadcast at most (shingles and anchors of the benchmark, ids of documents with a hit); more are joined by a shuffle.
BROADCAST = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, which is a table, to be broadcast if it has BROADCAST rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` words, from the words' hashes."""
    at = lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)])
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), at)).otherwise(none)


def by_width(df: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each row with a text and each width of shingles."""
    hashed = df.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    every = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), shingles(F.col("hashes"), w).alias("shingles")) for w in widths]))
    keep = [c for c in df.columns if c != "text"]
    return hashed.select(*keep, every.alias("s")).select(*keep, "s.width", "s.shingles")


def simhash(column: str) -> Column:
    """The 64 bits set in over half of an array's hashes."""
    return F.expr(
        f"aggregate(transform(sequence(0, 63), b -> if(2 * size(filter({column}, h -> getbit(h, b) = 1)) > size({column}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)"
    )


def least(window: Column, item: Column) -> Column:
    """Shared shingles that similarity THRESHOLD takes: c / (window + item - c) >= THRESHOLD."""
    return F.ceil((window + item) * F.lit(THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")


def similarity(window: str, item: str) -> Column:
    """Weighted Jaccard similarity of two multisets: sum of smaller over sum of larger counts."""
    shared = f"aggregate(array_distinct({item}), 0, (n, h) -> n + least(size(filter({window}, x -> x = h)), size(filter({item}, x -> x = h))))"
    return F.expr(f"{shared} / cast(size({window}) + size({item}) - {shared} as double)")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and item, the most similar window of
    the item's number of words (the whole document if it is shorter), where that reaches THRESHOLD.

    Words are runs without white space, A-Z lower-cased; items of under 5 words are one shingle. Null and empty texts
    match nothing; repeated rows give what one gives. Ties go to the first of the windows that start at a hit (see above) or are the
    text's last. Extra columns are ignored.
    """
    docs = columns_or_null(docs, doc_id="bigint", text="string")
    items = columns_or_null(benchmark, item_id="bigint", text="string").withColumn("n_words", F.size(words(F.col("text")))).where("n_words > 0").distinct()
    widths = sorted(r.width for r in items.select(F.least("n_words", F.lit(WIDTH)).alias("width")).distinct().collect())
    if not widths:
        return literal_rows(docs.sparkSession, [], "doc_id bigint, item_id bigint, start_word int, n_words int, similarity double")
    item = by_width(items, widths).where(F.col("width") == F.least("n_words", F.lit(WIDTH))).withColumnRenamed("shingles", "item_shingles")
    listed = Table(item.select("item_id", "item_shingles", "n_words", F.explode("item_shingles").alias("shingle")), "listed").df
    often = Table(listed.groupBy("n_words", "shingle").agg(F.count("*").alias("often")), "often").df
    anchors = listed.join(often, ["n_words", "shingle"]).groupBy("item_id", "n_words", "item_shingles").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("order"))
    # of an item's m shingles THRESHOLD * m stand in any window that reaches the threshold, however short
    first = F.expr(f"slice(order, 1, cast(size(order) - ceil(size(order) * {THRESHOLD} - 1e-9) + 1 as int)).shingle")
    item = Table(anchors.select("item_id", "n_words", "item_shingles", F.array_distinct(first).alias("anchors"), simhash("item_shingles").alias("item_fp")), "items").df
    wanted = bounded(often.select("n_words", "shingle"))

    some = by_width(docs, widths).select("doc_id", F.explode("shingles").alias("shingle"))
    some = Table(some.join(bounded(often.select("shingle").distinct()), "shingle", "left_semi").select(F.col("doc_id").alias("id")).distinct(), "some").df
    there = docs.join(bounded(some), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").distinct()
    texts = Table(by_width(there.withColumn("row", F.monotonically_increasing_id()), widths), "texts").df

    hits = texts.select("row", "width", F.posexplode("shingles").alias("at", "shingle")).join(wanted, "shingle")
    hits = hits.where(F.col("width") == F.least("n_words", F.lit(WIDTH))).groupBy("row", "width", "n_words").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    m = F.col("n_words") - F.col("width") + 1
    size = F.least(F.size("shingles"), m)
    ends = lambda p, i: F.get("hits", i + F.col("least") - 1) <= p + F.col("m") - 1
    starts = F.array_distinct(F.transform(F.filter("hits", ends), lambda p: F.least(p, F.size("shingles") - F.col("size"))))
    windows = hits.join(texts, ["row", "width"]).select("*", m.alias("m"), size.alias("size")).withColumn("least", least(F.col("size"), F.col("m")))
    cut = F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("shingles", s + 1, F.col("size")).alias("window"))))
    windows = windows.select("doc_id", "n_words", cut.alias("w")).select("doc_id", "n_words", F.col("w.start").alias("start_word"), "w.window", simhash("w.window").alias("fp"))

    places = Table(item.select("n_words", F.explode("anchors").alias("anchor"), "anchors", "item_id", "item_fp"), "anchors").df
    near = windows.select("*", F.explode(F.array_distinct("window")).alias("anchor")).join(bounded(places), ["n_words", "anchor"])
    near = near.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.get(F.filter("anchors", lambda a: F.array_contains("window", a)), F.lit(0)) == F.col("anchor")))
    near = Table(near.select("doc_id", "n_words", "start_word", "window", "item_id", "item_fp"), "near").df
    scored = near.join(item.select("item_id", "item_fp", "n_words", "item_shingles"), ["item_id", "item_fp", "n_words"])
    scored = scored.select("doc_id", "item_id", "start_word", "n_words", F.round(similarity("window", "item_shingles"), 9).alias("similarity")).where(F.col("similarity") >= THRESHOLD)
    best = scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("b"))
    return best.select("doc_id", "item_id", "b.start_word", "b.n_words", "b.similarity")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
