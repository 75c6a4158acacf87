"""Reading drawings: JSON, gzipped JSON, zip bundles, and shallow rows of SVG."""

from __future__ import annotations

import gzip
import io
import json
import sys
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import css_color, path_tokens, style_map

#: Decompressed bytes of a file at most; larger ones are rows with an error (a small file may hold a huge one).
LARGEST = 1 << 28
FIELDS = "path string, name string, text string, error string"


def _gunzip(data: bytes) -> bytes:
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        out = f.read(LARGEST + 1)
    if len(out) > LARGEST:
        raise ValueError("too large")
    return out


def plain_or_gzip(data: bytes) -> list[tuple[str, str]]:
    """One document; gzip is known by its first two bytes."""
    return [("", (_gunzip(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8-sig"))]


def bundle(data: bytes) -> list[tuple[str, str]]:
    """The animations of a zip bundle by id, in the manifest's order; without a manifest all under animations/."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        ids = [a["id"] for a in json.loads(z.read("manifest.json")).get("animations", [])] if "manifest.json" in names else sorted(n[11:-5] for n in names if n.startswith("animations/") and n.endswith(".json"))
        out = []
        for i in ids:
            if (entry := f"animations/{i}.json") in names:
                if z.getinfo(entry).file_size > LARGEST:
                    raise ValueError("too large")
                out.append((i, z.read(entry).decode("utf-8-sig")))
        return out


def _read(parse: Callable[[bytes], list[tuple[str, str]]]) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows += [(path, name, text, None) for name, text in parse(data.as_py())]
                except Exception as e:  # a bad file is a row with its error
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["path", "name", "text", "error"])

    return read


#: Readers by format; the extensions are those that are looked for.
FORMATS: dict[str, tuple[str, Callable]] = {"json": ("*.json", plain_or_gzip), "gzip": ("*.{tgs,gz}", plain_or_gzip), "bundle": ("*.{zip,lot}", bundle)}


def read_drawings(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(path, name, text, error): every drawing under root of a format, a file that can't be read as its error."""
    glob, parse = FORMATS[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")
    return files.mapInArrow(_read(parse), FIELDS)


def register(kind: str, glob: str, parse: Callable[[bytes], list[tuple[str, str]]]) -> None:
    """Adds a format: a glob and a function from bytes to (name, text) pairs."""
    FORMATS[kind] = (glob, parse)


#: Elements of SVG that draw, and the attributes that rows of them carry.
SHAPES = "rect|circle|ellipse|line|polyline|polygon|path|text|use"


def svg_elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, element, attributes map): the drawing elements of SVG text, in order, nesting left aside."""
    found = F.regexp_extract_all(text, F.lit(rf"(<(?:{SHAPES})\b[^>]*>)"), 1)
    rows = docs.select(key, F.posexplode(found).alias("pos", "tag"))
    pairs = F.regexp_extract_all("tag", F.lit(r'([A-Za-z_][-A-Za-z0-9_:.]*\s*=\s*"[^"]*")'), 1)
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.regexp_extract(p, r'"([^"]*)"$', 1).alias("value")))
    last = F.map_from_entries(F.filter(entries, lambda e: F.size(F.filter(entries, lambda o: o["key"] == e["key"])) == 1))
    return rows.select(key, "pos", F.regexp_extract("tag", r"^<(\w+)", 1).alias("element"), last.alias("attributes"))


def svg_primitives(elements: DataFrame) -> DataFrame:
    """Boxes as centre, size and rounding; circles as ellipses; paths as tokens; fill colours with styles over attributes."""
    a = lambda name: F.coalesce(F.col("attributes")[name].try_cast("double"), F.lit(0.0))
    kind = F.col("element")
    style = F.coalesce(style_map(F.coalesce(F.col("attributes")["style"], F.lit(""))), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    is_rect, is_round = kind == "rect", kind.isin("circle", "ellipse")
    rx = F.when(kind == "circle", a("r")).otherwise(a("rx"))
    ry = F.when(kind == "circle", a("r")).otherwise(a("ry"))
    return elements.select(
        "*",
        F.when(is_rect, F.array(a("x") + a("width") / 2, a("y") + a("height") / 2)).when(is_round, F.array(a("cx"), a("cy"))).alias("center"),
        F.when(is_rect, F.array(a("width"), a("height"))).when(is_round, F.array(rx * 2, ry * 2)).alias("size"),
        F.when(is_rect, (a("rx") + a("ry")) / 2).alias("rounding"),
        F.when(kind == "path", path_tokens(F.coalesce(F.col("attributes")["d"], F.lit("")))).alias("path"),
        css_color(F.coalesce(style["fill"], F.col("attributes")["fill"], F.lit("black"))).alias("fill"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
