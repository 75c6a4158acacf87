"""Embedding near-duplicates (operator 3): an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2 t) of one another. Vectors are projected on their leading
principal dimensions, sorted by the grid cells (width eps) there, and the sequence is cut into blocks, each a file in
the shared folder. Blocks whose boxes lie over eps apart never meet. Of the others the names travel, in grid order, and
tasks memory-map the files; so what is shuffled doesn't grow with the pairs of blocks times their vectors. They are joined by halving both intervals recursively: two
intervals whose boxes lie over eps apart are skipped, short ones are compared by matrix products in double
precision. Equal vectors are one node with a count, so a group of copies costs one comparison.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Table, columns_or_null, components, load, new_path, posix, save, spanning

THRESHOLD = 0.9
#: Principal dimensions that order the sequence, and that boxes hold.
ORDER_DIMS, BOX_DIMS = 4, 16
#: Vectors to a block, and to an interval that isn't halved any more.
BLOCK, LEAF = 4096, 256
#: What box distances and the margin of a first test may be off by.
SLACK = 1e-6


def unit(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of length one, shorter vectors padded with zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    x, row = np.zeros((len(size), dims)), np.repeat(np.arange(len(size)), size)
    x[row, np.arange(len(row)) - (np.cumsum(size) - size)[row]] = vectors.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(dims: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xx = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = unit(b.column("embedding"), dims)
                n, s, xx = n + len(x), s + x.sum(0), xx + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([xx.ravel().tolist()])], ["n", "s", "xx"])

    return add


def principal(nodes: DataFrame, dims: int) -> np.ndarray:
    """Principal directions, leading ones first: from sums that each task makes, dims squared numbers each."""
    parts = nodes.select("embedding").mapInArrow(_moments(dims), "n double, s array<double>, xx array<double>")
    each = parts.select("n", F.posexplode(F.concat("s", "xx")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    v = np.zeros(dims + dims * dims)
    for r in each:
        v[r.i] = r.x / r.n
    mean, second = v[:dims], v[dims:].reshape(dims, dims)
    return np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1]


def _cells(axes: np.ndarray, eps: float) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column("embedding"), len(axes))
                cells = np.floor(x @ axes[:, :ORDER_DIMS] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*b.schema.names, "cell"])

    return place


def _blocks(axes: np.ndarray, path: str) -> Callable:
    """Rows arrive in grid order; a block is a file of their vectors, told by its name and its box on the box dimensions."""
    schema = pa.schema([("name", pa.string()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def block(k: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        x = unit(rows.column("embedding").combine_chunks(), len(axes))
        y = x @ axes[:, :BOX_DIMS]
        # an attempt's own name: only blocks of the attempt that counts are known
        name = f"{TaskContext.get().partitionId():08d}-{k:08d}-{os.urandom(4).hex()}"
        save(path, name, x=x, ids=rows.column("node").to_numpy(), copies=rows.column("copies").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, y.min(0).tolist(), y.max(0).tolist()), schema, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, k = [], 0, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, BLOCK - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == BLOCK:
                    yield block(k, held)
                    held, n, k = [], 0, k + 1
        if held:
            yield block(k, held)

    return cut


def apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
    return float(np.sqrt((gap * gap).sum()))


def join_sequences(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine >= threshold; if both are the same sequence, each pair once."""
    eps = np.sqrt(2 - 2 * threshold) + SLACK
    px, py = x @ axes[:, :BOX_DIMS], y @ axes[:, :BOX_DIMS]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    box: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(which: int, p: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (which, a, b) not in box:
            box[which, a, b] = (p[a:b].min(0), p[a:b].max(0))
        return box[which, a, b]

    def recur(a: int, b: int, c: int, d: int) -> None:
        if same and d <= a or apart(*bounds(0, px, a, b), *bounds(1, py, c, d)) > eps:
            return
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= threshold)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append((i, j))
            return
        mid, mid2 = (a + b) // 2, (c + d) // 2
        for s, e in ((a, mid), (mid, b)) if b - a > LEAF else ((a, b),):
            for s2, e2 in ((c, mid2), (mid2, d)) if d - c > LEAF else ((c, d),):
                recur(s, e, s2, e2)

    recur(0, len(x), 0, len(y))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(v) for v in zip(*found, strict=True))
    return i, j


def _join(axes: np.ndarray, threshold: float, path: str) -> Callable:
    """For a pair of blocks: (node, its copies' links, a node it is connected with)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = None, {}
        for b in batches:
            for name, name2 in zip(b.column("name").to_pylist(), b.column("name2").to_pylist(), strict=True):
                if name != held:
                    held, one = name, load(path, name)
                same = name == name2
                two = one if same else load(path, name2)
                x = one["x"]
                i, j = join_sequences(x, two["x"], axes, threshold, same)
                if not len(i):
                    continue
                ids, copies = (np.concatenate([one[c]] + [two[c]] * (not same)) for c in ("ids", "copies"))
                j = j if same else j + len(x)
                links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                to = np.arange(len(ids))
                node, low = spanning(i, j, len(ids))
                to[node] = low
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[to[hit]])], ["node", "links", "other"])

    return join


def similar(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row (vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Linked: cosine >= threshold in double precision. Null vectors, zero ones, and those with a null or non-finite
    component link with nothing and name their own component; shorter vectors count as padded with zeros. Equal
    rows link with each other. Empty tables give no rows; other columns are ignored.
    """
    rows = columns_or_null(vectors, vec_id="bigint", embedding="array<double>")
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(
        F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0), F.lit(False)
    )
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    distinct = rows.where("embedding is not null").groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    nodes = Table(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors").df
    dims = nodes.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes, eps = principal(nodes, dims), float(np.sqrt(2 - 2 * threshold))
    spark, n = vectors.sparkSession, nodes.count()
    kept = "node bigint, embedding array<double>, copies bigint"
    placed = nodes.select("node", "embedding", "copies").mapInArrow(_cells(axes, eps), f"{kept}, cell array<int>")
    placed = placed.repartitionByRange(max(1, -(-n // (2 * BLOCK))), "cell", "embedding").sortWithinPartitions("cell", "embedding")
    path = posix(new_path(spark, "vectors"))
    blocks = Table(placed.mapInArrow(_blocks(axes, path), "name string, lo array<double>, hi array<double>"), "blocks").df
    # a row for thousands of vectors: blocks meet where their cells on the first dimension touch
    meta = blocks.select("name", "lo", "hi", *[F.floor(F.col(k)[0] / eps).cast("bigint").alias(f"{k}_cell") for k in ("lo", "hi")])
    left = meta.select("name", "lo", "hi", F.explode(F.sequence(F.col("lo_cell") - 1, F.col("hi_cell") + 1)).alias("cell"))
    right = meta.select(*[F.col(k).alias(f"{k}2") for k in ("name", "lo", "hi")], F.explode(F.sequence("lo_cell", "hi_cell")).alias("cell"))
    minus = lambda u, v: F.zip_with(u, v, lambda a, b: a - b)
    gaps = F.zip_with(minus("lo", "hi2"), minus("lo2", "hi"), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g) <= (eps + SLACK) ** 2
    pairs = Table(left.join(right, "cell").where((F.col("name") <= F.col("name2")) & near).select("name", "name2").distinct(), "pairs").df
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.repartitionByRange(tasks, "name", "name2").sortWithinPartitions("name", "name2")
    found = Table(met.mapInArrow(_join(axes, threshold, path), "node bigint, links bigint, other bigint"), "links").df
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(comp, "node", "left").join(links, "node", "left")
    named = named.select("embedding", "low", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    label = named.join(low, "component").select("embedding", "links", "component_id")
    out = rows.join(label, "embedding", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


common.ship(__name__)
