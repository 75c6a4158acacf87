"""Quality classifier (operator 4): random-indexing word vectors, pooled, into a two-layer network.

Random indexing gives each word (hashed to a bucket) a sparse index vector of a few plus and minus ones; a word's
context vector is the sum of its neighbours' index vectors over the whole corpus, in whole numbers, so the order of
tasks doesn't matter. A document is the mean context vector of its words, the mean index vector of their marks (case,
punctuation at the end, repetition of the word before) and two norms. The network is numpy, its
probabilities are calibrated by one temperature on rows it wasn't fitted to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import columns_or_null, slices

#: Buckets of words and of marks, dimensions, plus and minus ones of an index vector, parts that sums travel in.
WORDS, MARKS, DIMS, ONES, PARTS = 1 << 14, 1 << 10, 32, 4, 16
#: Labelled rows that the network is fitted to at most: those whose ids hash lowest.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 128, 3e-3, 1e-4, 7


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n buckets the places of its ones, and their signs."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((n, DIMS)), axis=1)[:, :ONES]
    return place, rng.integers(0, 2, (n, ONES)) * 2 - 1


def dense(place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    out = np.zeros((len(place), DIMS), np.float32)
    np.put_along_axis(out, place, sign.astype(np.float32), axis=1)
    return out


def mark(word: str) -> str:
    """Case and the last signs of a word."""
    body = word.rstrip("".join({c for c in word if not c.isalnum()}))
    tail = word[len(body) :][:3]
    case = "sign" if not body else "digit" if any(c.isdigit() for c in body) else "upper" if len(body) > 1 and body.isupper() else "title" if body[0].isupper() else "lower"
    return f"{case}|{tail}"


class Coder:
    """Buckets of words and marks; words seen lately are remembered, MEMORY of them at most."""

    MEMORY = 400_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.marks: dict[str, tuple[int, int]] = {}

    def one(self, w: str) -> int:
        """The word's bucket, its mark's, and its mark's as a repetition, 20 bits each."""
        if w.isalpha():
            body, m = w.lower(), "lower|" if w.islower() else mark(w)
        else:
            body, m = "".join(filter(str.isalnum, w)).lower() or w, mark(w)
        if m not in self.marks:
            self.marks[m] = tuple(xxhash.xxh32_intdigest((p + m).encode("utf-8", "surrogatepass")) % MARKS for p in ("", "again|"))
        first, again = self.marks[m]
        return xxhash.xxh32_intdigest(body.encode("utf-8", "surrogatepass")) % WORDS | first << 20 | again << 40

    def codes(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > self.MEMORY:
            known.clear()
        for w in some:
            if w not in known:
                known[w] = self.one(w)
        packed = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
        return packed & 0xFFFFF, packed >> 20 & 0xFFFFF, packed >> 40


def tokens(texts: pa.Array, coder: Coder | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and mark buckets of all words, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, per = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    end = np.cumsum(per)
    per = before[end] - before[end - per]
    coded = flat.filter(real).dictionary_encode()
    (cores, firsts, agains), at = (coder or Coder()).codes(coded.dictionary.to_pylist()), coded.indices.to_numpy()
    core = cores[at]
    again = np.zeros(len(at), np.int64)
    again[1:] = core[1:] == core[:-1]
    again[(np.cumsum(per) - per)[per > 0]] = 0
    return core, np.where(again, agains[at], firsts[at]), per


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors(WORDS, SEED)
    total, coder = np.zeros(WORDS * DIMS, np.int64), Coder()
    for batch in batches:
        for b in slices(batch, "text"):
            core, _, per = tokens(b.column("text"), coder)
            text = np.repeat(np.arange(len(per)), per)
            near = text[1:] == text[:-1]
            left, right = core[:-1][near], core[1:][near]
            for word, other in ((left, right), (right, left)):
                for k in range(ONES):
                    total += np.bincount(word * DIMS + place[other, k], sign[other, k], WORDS * DIMS).astype(np.int64)
    for k, part in enumerate(np.split(total, PARTS)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(part.astype(np.int32).tobytes(), codec="zstd", asbytes=True)])], ["part", "sums"])


def _summed(table: pa.Table) -> pa.Table:
    size = WORDS * DIMS // PARTS
    total = sum(np.frombuffer(pa.decompress(x.as_py(), 4 * size, codec="zstd", asbytes=True), np.int32).astype(np.int64) for x in table.column("sums"))
    return pa.table({"part": table.column("part")[:1], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors over all of docs, unit length after damping: a table of fixed size."""
    texts = columns_or_null(docs, text="string")
    rows = texts.mapInArrow(_contexts, "part int, sums binary").groupBy("part").applyInArrow(_summed, "part int, sums binary").collect()
    total = np.zeros((PARTS, WORDS * DIMS // PARTS))
    for r in rows:
        total[r.part] = np.frombuffer(r.sums, np.int64)
    v = total.reshape(WORDS, DIMS)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def sums(table: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of the table summed over each run of ids that begins at start, in pieces of whole runs."""
    out, stop = np.empty((len(start), table.shape[1])), np.append(start, len(ids))
    piece = np.searchsorted(start, np.arange(0, len(ids), 1 << 16))
    cut = np.unique(np.append(piece, len(start)))
    for a, b in zip(np.append(0, cut[:-1]) if cut[0] else cut[:-1], cut if cut[0] else cut[1:], strict=True):
        out[a:b] = np.add.reduceat(table[ids[stop[a] : stop[b]]], start[a:b] - start[a], axis=0, dtype=np.float64)
    return out


def features(texts: pa.Array, vectors: np.ndarray, marks: np.ndarray, coder: Coder | None = None) -> np.ndarray:
    core, mark_ids, per = tokens(texts, coder)
    out = np.zeros((len(per), 2 * DIMS + 2))
    full = np.flatnonzero(per)
    if len(full):
        start = (np.cumsum(per) - per)[full]
        for at, table, ids in ((0, vectors, core), (DIMS, marks, mark_ids)):
            out[full, at : at + DIMS] = sums(table, ids, start) / per[full, None]
    out[:, -2], out[:, -1] = (np.linalg.norm(out[:, a : a + DIMS], axis=1) for a in (0, DIMS))
    return out


@dataclass
class Network:
    """Two layers over standardised features, and the temperature of its probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def constant(p: float, width: int) -> Network:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on four fifths of the rows, the temperature on the fifth that is left."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5, x.shape[1])
    rng = np.random.default_rng(SEED)
    aside = np.arange(len(y)) % 5 == 4
    xt, yt = x[~aside], y[~aside]
    mean, scale = xt.mean(0), xt.std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (xt - mean) / scale
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(EPOCHS, min(600, 200_000 // len(yt)))):
        for rows in np.array_split(rng.permutation(len(yt)), max(1, len(yt) // BATCH)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - yt[rows]) / len(rows)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    logit, ya = net.logit(x[aside]), y[aside]
    loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(ya > 0, 1, -1) * logit / t)))
    net.temperature = float(min(np.geomspace(0.5, 20, 200), key=loss))
    return net


def _features(vectors: np.ndarray) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, coder = dense(*index_vectors(MARKS, SEED + 1)), Coder()
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(features(b.column("text"), vectors, marks, coder)), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return each


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all of docs, and a network fitted to SAMPLE labelled rows at most that aren't held out."""
    vectors = word_vectors(docs)
    lab = columns_or_null(labels, doc_id="bigint", quality="int").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = columns_or_null(docs, doc_id="bigint", text="string").join(F.broadcast(lab), "doc_id")  # SAMPLE rows at most
    got = rows.select("doc_id", "quality", "text").mapInArrow(_features(vectors), "doc_id bigint, quality int, x array<double>").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    x, y = np.array([r.x for r in got]).reshape(-1, 2 * DIMS + 2), np.array([float(r.quality) for r in got])
    return vectors, fit(x, y)


def _scores(vectors: np.ndarray, net: Network, names: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, coder = dense(*index_vectors(MARKS, SEED + 1)), Coder()
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.score(features(b.column("text"), vectors, marks, coder)))], names)

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column quality_score after its own (one of that name gives way), 0 to 1, high for label 1.

    Null texts count as empty; an empty text scores like any, equal texts score alike. Without labels, or with those
    of one kind alone, every row scores their share (a half without any). Empty tables give no rows.
    """
    vectors, net = train(docs, labels)
    docs = docs.drop("quality_score") if "quality_score" in docs.columns else docs
    names = [*docs.columns, "quality_score"]
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])
    return docs.mapInArrow(_scores(vectors, net, names), schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_or_null(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


common.ship(__name__)
