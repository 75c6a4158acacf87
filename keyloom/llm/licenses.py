"""License scans (operator 6): a positional index of rare licence words, DataFrame functions only.

First pass: each file's words, and for files that hold all words of some key phrase the positions of every
template word in them. The words' document counts over all files give their IDF, and every template is posted
under its rarest key word. Second pass, on that small table: the rare words of a file lead to its candidates, whose
key words' postings are intersected by relative position, the rarest first; what remains are places where the whole key phrase
stands. The score is the IDF-weighted part of the template's words that stand in place around the phrase, best over all places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, columns_or_null


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def at(self) -> int:
        """Where the key phrase stands in the notice."""
        w, q = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(q)] == q)


#: Labels, notices, mandatory key phrases; the contract's first.
TEMPLATES = (
    Template("gpl", "this work is licensed under the gnu general public license version", "gnu general public license", True),
    Template("apache", "licensed under the apache license version", "apache license", True),
    Template("cc-by", "this work is licensed under cc by", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("public-domain", "released into the public domain", "public domain"),
    Template("unlicense", "this is free and unencumbered software", "free and unencumbered software"),
)

#: What stands between words, in Java's and Python's notation; A-Z is lower case by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: What lower() may change besides A-Z lies among capitals, title letters, number letters and symbols.
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """A-Z alone in lower case; lower() is the same, and quicker, where no other character has a lower case."""
    a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(OTHER_CAPITALS), F.translate(text, a_z, a_z.lower())).otherwise(F.lower(text))


def _at(word: Column) -> Column:
    """A word's positions among a file's postings."""
    return F.coalesce(F.get(F.filter("postings", lambda p: p["word"] == word), F.lit(0))["at"], F.array().cast("array<int>"))


def _shifted(word: Column) -> Column:
    """Where the phrase would start, for each position of one of its words."""
    return F.transform(_at(word["word"]), lambda p: p - word["i"])


def _entry(t: Template, idf: dict[str, float]) -> tuple[str, Column]:
    """A template's rarest key word, and the template as it hangs under it: key words, rarest first, and the notice's, by place from the phrase's start."""
    order = sorted(enumerate(t.key_words), key=lambda x: (-idf[x[1]], x[1], x[0]))
    key = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("i")) for i, w in order])
    notice = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i - t.at).alias("i"), F.lit(idf[w]).alias("idf")) for i, w in enumerate(t.words)])
    return order[0][1], F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), key.alias("key"), notice.alias("notice"), F.lit(sum(idf[w] for w in t.words)).alias("total"))


def _places(t: Column) -> Column:
    """Where the key phrase starts: the rarest key word's positions, and of the others those that fit."""
    first = F.array_distinct(_shifted(F.get(t["key"], F.lit(0))))
    return F.aggregate(F.slice(t["key"], 2, F.greatest(F.size(t["key"]) - 1, F.lit(0))), first, lambda left, w: F.array_intersect(left, _shifted(w)))


def _score(t: Column) -> Column:
    """The best place's share of the notice's IDF: the words that fit each place, sorted by place and added up run by run."""
    fits = F.flatten(F.transform(t["notice"], lambda w: F.transform(F.array_intersect(t["places"], _shifted(w)), lambda p: F.struct(p.alias("place"), w["i"].alias("i"), w["idf"].alias("idf")))))

    def add(run: Column, fit: Column) -> Column:
        of_place = F.when(run["place"] == fit["place"], run["of_place"]).otherwise(F.lit(0.0)) + fit["idf"]
        return F.struct(fit["place"].alias("place"), of_place.alias("of_place"), F.greatest(run["best"], of_place).alias("best"))

    zero = F.struct(F.lit(-1).alias("place"), F.lit(0.0).alias("of_place"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sort_array(fits), zero, add, lambda run: run["best"]) / t["total"]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, score): a row for each row of docs.

    places: (start, label, base) of every key phrase, words counted from 0; score: 0 to 1, 0 without a place. Null
    texts count as empty: no words, no places. Repeated rows are scanned each for itself. Extra columns are ignored.
    A file's work grows with the templates whose rarest key word it holds, not with all of them.
    """
    rows = columns_or_null(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for t in templates for w in t.words})
    listed = F.array(*map(F.lit, vocabulary))
    split = rows.select("doc_id", F.filter(F.split(lower_ascii(F.col("text")), SEPARATORS, -1), lambda w: w != "").alias("words"))
    present = split.select("doc_id", "words", F.array_intersect(listed, F.col("words")).alias("present"))
    # phrases by their longest word: only those that hang under a word of the file are looked through
    phrases: dict[str, set[tuple[str, ...]]] = {}
    for t in templates:
        phrases.setdefault(max(t.key_words, key=len), set()).add(tuple(t.key_words))
    of_word = F.create_map(*[x for w, keys in sorted(phrases.items()) for x in (F.lit(w), F.array(*[F.array(*map(F.lit, k)) for k in sorted(keys)]))])
    held = F.array_intersect("present", F.array(*map(F.lit, sorted(phrases))))
    complete = F.exists(held, lambda w: F.exists(F.element_at(of_word, w), lambda key: F.forall(key, lambda k: F.array_contains("present", k))))
    positions = lambda w: F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i) == w)
    postings = F.transform("present", lambda w: F.struct(w.alias("word"), positions(w).alias("at")))
    table = present.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "present", F.when(complete, postings).alias("postings"))
    index = Table(table, "licences").df
    # IDF by word: as many rows as the templates have words
    counts = index.select(F.explode("present").alias("word")).groupBy("word").count()
    n = index.count()
    found = {r.word: r["count"] for r in counts.collect()}
    idf = {w: round(1.0 + math.log((n + 1) / (found.get(w, 0) + 1)), 9) for w in vocabulary}
    under: dict[str, list[Column]] = {}
    for t in templates:
        rare, entry = _entry(t, idf)
        under.setdefault(rare, []).append(entry)
    by_rare = F.create_map(*[x for w, entries in sorted(under.items()) for x in (F.lit(w), F.array(*entries))])
    rare = F.array_intersect("present", F.array(*map(F.lit, sorted(under))))
    candidates = F.flatten(F.transform(rare, lambda w: F.element_at(by_rare, w)))
    placed = F.filter(F.transform(candidates, lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), t["notice"].alias("notice"), t["total"].alias("total"), _places(t).alias("places"))), lambda t: F.size(t["places"]) > 0)
    hits = index.select("doc_id", "n_words", "postings", F.when(F.col("postings").isNotNull(), placed).alias("hits"))
    each = F.flatten(F.transform("hits", lambda t: F.transform(t["places"], lambda p: F.struct(p.alias("start"), t["label"].alias("label"), t["base"].alias("base")))))
    best = F.round(F.array_max(F.transform("hits", _score)), 6)
    return hits.select("doc_id", "n_words", F.coalesce(F.sort_array(each), F.array().cast("array<struct<start:int,label:string,base:boolean>>")).alias("places"), F.coalesce(best, F.lit(0.0)).alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        "score",
    )
