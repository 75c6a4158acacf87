"""What the training-data operators share: the folder all executors see, cut lineage, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import json
import mmap
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_LEFT: set[str] = set()


def ship(name: str) -> None:
    """Send a module's functions to workers by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own; a cluster without the setting is refused,
    since a machine-local folder there would lose files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        base = _OWN[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of the application's own in the shared folder; all of them go when the driver's process ends."""
    own = f"{shared_dir(spark)}/keyloom/{spark.sparkContext.applicationId}"
    if own not in _LEFT:
        _LEFT.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _leave(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        drop_path(spark, path)


def posix(path: str) -> str:
    """The path under which workers open files of the shared folder themselves."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise RuntimeError(f"{path} must be mounted on the workers: its files are memory-mapped there")
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save(path: str, name: str, **arrays: np.ndarray) -> None:
    """One file of named arrays; whole or not at all, whichever attempt of the task comes last."""
    os.makedirs(path, exist_ok=True)
    at, head = 0, {}
    for k, x in arrays.items():
        head[k] = [x.dtype.str, x.shape, at]
        at += -(-x.nbytes // 64) * 64
    told = json.dumps(head).encode()
    start = -(-(8 + len(told)) // 64) * 64
    own = f"{path}/.{name}-{os.getpid()}-{os.urandom(6).hex()}"
    with open(own, "wb") as f:
        f.write(start.to_bytes(8, "little") + told.ljust(start - 8))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))
    os.replace(own, f"{path}/{name}.bin")


def load(path: str, name: str) -> dict[str, np.ndarray] | None:
    """A file's arrays over one memory map, which keeps no file open; None if there is none."""
    try:
        with open(f"{path}/{name}.bin", "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    except FileNotFoundError:
        return None
    start = int.from_bytes(whole[:8], "little")
    out = {}
    for k, (kind, shape, at) in json.loads(whole[8:start]).items():
        size = int(np.prod(shape))
        out[k] = np.frombuffer(whole, kind, size, start + at).reshape(shape) if size else np.empty(shape, kind)
    return out


class Table:
    """A frame written to the shared folder and read again: lineage ends there and lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def stored(df: DataFrame, label: str) -> DataFrame:
    return Table(df, label).df


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among n local nodes, reduced to (node, smallest node of its component): n - 1 links at most."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), longs: (node, component), the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregation (with map-side minima), written down, and a join
    with it that adaptive execution splits when a node is hot; no neighbour list is ever gathered. Every round is written
    to the shared folder. Nodes without links are absent.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    table, last = Table(e, "edges"), None
    while True:
        both = table.df.unionByName(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = Table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = both.join(lows.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = Table(large, "edges")
        lows.drop()
        lows = Table(mid.df.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = mid.df.join(lows.df, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        nxt = Table(small, "edges")
        lows.drop()
        mid.drop()
        table.drop()
        table = nxt
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == last or not now[0]:
            return table.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(table.df.select("v", F.col("v")).toDF("node", "component").distinct())
        last = now


def give_back() -> None:
    """Hand what the C library and Arrow keep of freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of whole rows whose texts hold about `most` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(size) - size) // most
    cut = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(size)]]) if len(size) else [0]
    for a, b in zip(cut, cut[1:], strict=False):
        yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A-Z lower-cased words [^\\x20\\x09-\\x0D]+ of all texts in order, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, per = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    end = np.cumsum(per)
    return flat.filter(real), before[end] - before[end - per]


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan: no RDD, no Python."""
    names, types = zip(*[f.strip().split(" ", 1) for f in schema.split(",")], strict=True)
    empty = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in zip(names, types, strict=True)) + ">>")
    made = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types, strict=True)]) for r in rows]) if rows else empty
    return spark.range(1).select(F.inline(made))


#: Steps of a fold that append to one array.
FOLD = 256


def folded(n: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The array that n steps append to, each given (at, i) and giving the next `at` and an array; `at` starts at 0.

    An append copies what is there, so steps append to arrays of FOLD steps, and these to the whole.
    """
    start = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one(acc: Column, i: Column) -> Column:
        at, more = step(acc["at"], i)
        return start(at, F.concat(acc["out"], more))

    def block(acc: Column, b: Column) -> Column:
        inside = F.sequence(b * FOLD, F.least(n, (b + 1) * FOLD) - 1)
        return F.aggregate(inside, start(acc["at"], none), one, lambda got: start(got["at"], F.concat(acc["out"], F.array(got["out"]))))

    whole = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int")), start(F.lit(0), F.slice(F.array(none), 1, 0)), block, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, whole).otherwise(none)


def plainly(df: DataFrame, prefix: str = "c") -> DataFrame:
    """df with columns named by number, so that no name of its own clashes; toDF(*df.columns) brings the names back."""
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; one that is missing is null. Other columns, however named, are left behind."""
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = plainly(df)
    return plain.select(*[(F.col(f"c{have[c]}") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


ship(__name__)
