"""Reworking drawings: sticker sanitising, split positions, group summaries, line differences, bundles."""

from __future__ import annotations

import difflib
import io
import json
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sticker's side, and the rates that others are moved to.
SIDE, SLOW, FAST, BETWEEN = 512, 30, 60, 45


def sticker_scale(w: Column, h: Column) -> Column:
    """What a drawing is scaled by to fit a sticker."""
    return F.least(F.lit(float(SIDE)) / w, F.lit(float(SIDE)) / h)


def sticker_rate(rate: Column) -> Column:
    return F.when(rate < BETWEEN, SLOW).otherwise(FAST)


def join_position(x: DataFrame, y: DataFrame, key: str, t: str) -> DataFrame:
    """(key, t, value [x, y]): two split coordinates at the union of their times, from segments (key, t, start, end)."""
    from .keyframes import value_at

    times = x.select(key, t).unionByName(y.select(key, t)).distinct()
    a, b = (value_at(s, times, key, t).withColumnRenamed("value", n) for s, n in ((x, "x"), (y, "y")))
    return a.join(b, [key, t]).select(key, t, F.array("x", "y").alias("value"))


def group_paint(shapes: DataFrame, group: list[str]) -> DataFrame:
    """(group, fill, stroke, n_paths): of each group the first fill, the widest stroke (the first of equal ones), its paths.

    shapes: (group, pos, ty, nm, width).
    """
    pick = lambda ty, value, order: F.min_by(F.when(F.col("ty") == ty, value), F.when(F.col("ty") == ty, order))
    return shapes.groupBy(*group).agg(
        pick("fl", F.col("nm"), F.struct("pos")).alias("fill"),
        pick("st", F.col("nm"), F.struct(-F.col("width"), "pos")).alias("stroke"),
        F.count_if(F.col("ty").isin("sh", "rc", "el", "sr")).alias("n_paths"),
    )


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for left, right in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            a, c = (left or "").splitlines(), (right or "").splitlines()
            moves = difflib.SequenceMatcher(None, a, c, autojunk=False).get_opcodes()
            out.append([{"kind": k, "left": a[i:j], "right": c[m:n]} for k, i, j, m, n in moves if k != "equal"])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["key", "changes"])


def line_changes(docs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, changes): lines replaced, deleted and inserted between two texts."""
    return docs.select(F.col(key).cast("bigint").alias("key"), left, right).mapInArrow(_lines, "key bigint, changes array<struct<kind:string,left:array<string>,right:array<string>>>")


def bundle_bytes(docs: list[tuple[str, str]]) -> bytes:
    """A zip bundle of (id, text): a manifest and the animations, the same bytes for the same documents."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        entries = [("manifest.json", json.dumps({"version": "1.0", "animations": [{"id": i} for i, _ in docs]}))] + [(f"animations/{i}.json", t) for i, t in docs]
        for name, text in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [bundle_bytes([(d["id"], d["text"]) for d in docs]) for docs in b.column("docs").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("bundle"), pa.array(data, pa.binary())], ["bundle", "content"])


def bundles(docs: DataFrame, bundle: str, name: str, text: str) -> DataFrame:
    """(bundle, content): a zip of each bundle's documents, ids made safe. A bundle is one file, so its documents meet in a task."""
    from ..functions.text import slug

    one = docs.groupBy(F.col(bundle).cast("string").alias("bundle")).agg(F.array_sort(F.collect_list(F.struct(slug(F.col(name)).alias("id"), F.col(text).alias("text")))).alias("docs"))
    return one.mapInArrow(_bundle, "bundle string, content binary")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
