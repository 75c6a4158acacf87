"""Personal data (operator 1): bootstrapped contextual extraction.

Spans of four exact kinds are the seeds. The candidates are all other tokens that aren't plain words. Each seed and each
candidate leaves its instance and the lexical patterns around it: the two words before, the two after, the one on either
side. Over the graph of patterns and instances Spark scores in turns: a pattern by the mean confidence of all instances that it
surrounds, an instance by the patterns it has, and by its shape as a weaker feature. Patterns of high confidence and enough support
pass their kind on to candidates of any shape, whose spans are added as `<kind>_ctx`; the seeds' spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Table, columns_or_null, plainly

KINDS = ("email", "ip", "card", "phone")
#: Of bootstrapping: rounds, a pattern's least confidence and different sure instances, an instance's least confidence.
ROUNDS, LEAST_PATTERN, LEAST_SUPPORT, LEAST_INSTANCE = 3, 0.8, 3, 0.9
#: Rows of trusted instances, of patterns with support, and of what is found, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000
#: What a shape's score weighs beside those of lexical patterns.
SHAPE_WEIGHT = 0.3
#: Punctuation that belongs to neither a candidate nor a context word at its ends, and marks that plain words hold.
ENDS, INNER = ".,;:!?\"'`´‘’“”«»[]{}<>|", str.maketrans("", "", "'’-")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
SHAPE = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping, in linear time: each @ is tried once, with all of the local part before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four exact kinds, in their order and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(run: str) -> str:
    """Runs of digits (9, from eight on N), capitals and small letters as one sign each, other characters as they are."""
    out = []
    for m in SHAPE.finditer(run):
        c = m[0][0]
        out.append(c if not (c.isalnum() and c.isascii()) else "9N"[len(m[0]) >= 8] if c.isdigit() else "A" if c.isupper() else "a")
    return "".join(out)


def candidates(text: str, tokens: list[tuple[int, int]], taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of what isn't a plain word and touches no base span: one token, or some in a row with digits in each.

    Punctuation at a token's ends is left out; it ends a row, as a word does.
    """
    spans, k = sorted((a, b) for _, a, b in taken), 0
    row: tuple[int, int] | None = None
    for a, b in tokens:
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        token = text[a:b]
        if token.isalpha() or k < len(spans) and spans[k][0] < b:
            plain = True
        else:
            core = token.strip(ENDS)
            plain = not core or core.translate(INNER).isalpha() or not any(map(str.isalnum, core))
        if plain:
            if row:
                yield row
            row = None
            continue
        start = a + token.index(core)
        end, digits = start + len(core), DIGITS.search(core) is not None
        if row and (start > a or not digits):
            yield row
            row = None
        row = (row[0] if row else start, end)
        if end < b or not digits:
            yield row
            row = None
    if row:
        yield row


def patterns(text: str, tokens: list[tuple[int, int]], starts: list[int], start: int, end: int) -> list[int]:
    """Hashes of a span's lexical contexts: two words before, two after, one on either side; lower case, without punctuation at the ends."""
    before, after = [], []
    at = bisect_left(starts, start)
    for k in range(at - 1, max(-1, at - 4), -1):  # the first may be the rest of the span's own token
        if w := text[tokens[k][0] : min(tokens[k][1], start)].strip(ENDS).lower():
            before.append(w)
    at = max(0, bisect_left(starts, end) - 1)
    for k in range(at, min(len(tokens), at + 4)):
        if w := text[max(tokens[k][0], end) : tokens[k][1]].strip(ENDS).lower():
            after.append(w)
    found = []
    if len(before) > 1:
        found.append(f"{before[1]} {before[0]} _")
    if len(after) > 1:
        found.append(f"_ {after[0]} {after[1]}")
    if before and after:
        found.append(f"{before[0]} _ {after[0]}")
    return [hashed(p) for p in found]


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SEEN = "array<struct<kind:string,start:int,end:int,instance:bigint,shape:bigint,patterns:array<bigint>>>"
FOUND = "doc_id bigint, text_hash bigint, base array<struct<kind:string,start:int,end:int>>, base_sha256 string, seen " + SEEN


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    seen_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("shape", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    for b in batches:
        base, digest, seen = [], [], []
        for t in b.column("text"):
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            digest.append(hashlib.sha256(joined(spans).encode()).hexdigest())
            tokens = [m.span() for m in TOKEN.finditer(text)]
            starts = [a for a, _ in tokens]
            every = spans + [(None, a, z) for a, z in candidates(text, tokens, spans)]
            seen.append(
                [
                    {"kind": k, "start": a, "end": z, "instance": hashed(text[a:z].lower()), "shape": hashed(shape(text[a:z])), "patterns": patterns(text, tokens, starts, a, z)}
                    for k, a, z in every
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(base, span), pa.array(digest, pa.string()), pa.array(seen, seen_type)], ["doc_id", "text_hash", "base", "base_sha256", "seen"]
        )


def bounded(df: DataFrame) -> DataFrame:
    """df, which is read from a table, to be broadcast if it has BROADCAST rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def bootstrap(seen: DataFrame) -> DataFrame:
    """(instance, pattern, kind): what the pattern graph finds besides the seeds, and the sure patterns that find it.

    seen: (instance, kind or null, shape, pattern or null). An instance's trust is 1 for a seed's kind; else it is a noisy or over its sure
    patterns of a kind, 1 - product of (1 - score), with SHAPE_WEIGHT * its shape's score as one more factor. A pattern's score is the mean
    trust over all different instances it surrounds, a shape's likewise; so copies of a text weigh nothing. Each round looks at all patterns
    with LEAST_SUPPORT trusted instances; no other can be sure. All steps aggregate before they shuffle.
    """
    rows = seen.where("pattern is not null").select("pattern", "instance")
    seeds = Table(seen.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("trust", F.lit(1.0)), "seeds").df
    shapes = Table(seen.groupBy("instance").agg(F.min("shape").alias("shape")), "shapes").df
    of_shape = Table(shapes.groupBy("shape").agg(F.count("*").alias("n")), "shape_sizes").df
    known = seeds
    for _ in range(ROUNDS):
        trusted = bounded(known.where(F.col("trust") >= LEAST_INSTANCE).select("instance", "kind"))
        support = rows.join(trusted, "instance").distinct().groupBy("pattern", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= LEAST_SUPPORT)
        support = Table(support, "support").df
        edges = Table(rows.join(bounded(support.select("pattern")), "pattern", "left_semi").distinct(), "edges").df
        total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        scored = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("trust").alias("mass")).join(support, ["pattern", "kind"])
        scored = scored.join(total, "pattern").select("pattern", "kind", (F.col("mass") / F.col("n")).alias("score")).where(F.col("score") >= LEAST_PATTERN)
        doubt = F.sum(F.log(1 - F.least("score", F.lit(0.99))))
        sure = Table(scored, "scored").df
        rated = edges.join(sure, "pattern").groupBy("instance", "kind").agg(doubt.alias("doubt"))
        new = Table(rated.join(seeds.select("instance"), "instance", "left_anti"), "rated").df
        by_shape = shapes.join(known, "instance").groupBy("shape", "kind").agg(F.sum("trust").alias("mass")).join(of_shape, "shape").select("shape", "kind", (F.col("mass") / F.col("n")).alias("like"))
        both = new.join(shapes, "instance").join(by_shape, ["shape", "kind"], "left")
        trust = 1 - F.exp(F.col("doubt")) * (1 - SHAPE_WEIGHT * F.least(F.coalesce("like", F.lit(0.0)), F.lit(1.0)))
        best = both.select("instance", "kind", trust.alias("trust")).groupBy("instance").agg(F.max_by(F.struct("kind", "trust"), F.struct("trust", "kind")).alias("b")).select("instance", "b.kind", "b.trust")
        known = Table(seeds.unionByName(best), "known").df
    found = known.where(F.col("trust") >= LEAST_INSTANCE).join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind")
    return edges.join(found, "instance").join(sure.select("pattern", "kind"), ["pattern", "kind"]).select("instance", "pattern", "kind")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, base_sha256, spans): a row for each row of docs.

    base and spans are arrays of (kind, start, end), code points, ends exclusive, by kind in KINDS' order and then start;
    spans holds the base and then what the patterns add. Null texts count as empty and have none; repeated
    rows each have theirs; empty tables give no rows; other columns are ignored.
    """
    rows = columns_or_null(docs, doc_id="bigint", text="string").withColumn("text_hash", F.xxhash64("text"))
    found = Table(rows.mapInArrow(_find, FOUND).withColumn("row", F.monotonically_increasing_id()), "pii").df
    seen = found.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    more = Table(bootstrap(seen.select("kind", "instance", "shape", F.explode_outer("patterns").alias("pattern"))), "more").df
    more = bounded(more)
    # an instance counts where a sure pattern surrounds it, not wherever else its text stands
    slots = seen.where("kind is null").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    added = slots.join(more, ["instance", "pattern"]).select("row", F.struct(F.concat("kind", F.lit("_ctx")).alias("kind"), "start", "end").alias("span"))
    order = F.array(*[F.lit(f"{k}_ctx") for k in KINDS])
    extra = added.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, "span.kind").alias("rank"), "span.start", "span.end", "span.kind"))).alias("extra"))
    plain = F.transform("extra", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", plain))
    return found.join(extra, "row", "left").select("doc_id", "text_hash", "base", "base_sha256", spans.alias("spans"))


def _replace(at: int, schema: list[str]) -> Callable:
    """The column `at` with its spans replaced; schema: all columns, without the last, the spans."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                out, done = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        out += [t[done : s["start"]], f"[{s['kind'].removesuffix('_ctx').upper()}]"]
                    done = max(done, s["end"])
                texts.append("".join([*out, t[done:]]) if out else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(schema))], schema)

    return replace


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; all columns and rows stay, whatever the columns are named."""
    spans = extract(docs).select(F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"), F.col("spans").alias("pii_spans")).where(F.size("pii_spans") > 0).distinct()
    plain, at = plainly(docs), docs.columns.index("text")
    doc_id, text = (F.col(plain.columns[docs.columns.index(c)]) for c in ("doc_id", "text"))
    both = plain.join(spans, doc_id.eqNullSafe(F.col("pii_id")) & (F.xxhash64(text) == F.col("pii_hash")), "left").select(*plain.columns, "pii_spans")
    return both.mapInArrow(_replace(at, plain.columns), plain.schema).toDF(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], "base_sha256", line.alias("spans"))


common.ship(__name__)
