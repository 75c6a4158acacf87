"""Language-model scores (operator 8): an interpolated modified Kneser-Ney trigram model of the training rows.

The model is a set of sorted arrays in the shared folder, written by the tasks that count and memory-mapped by
the tasks that score; no task holds more than one part of it and the driver none.

* words: sorted 64-bit hashes with counts, cut by the hash's leading bits; a word's id is its rank;
* bigrams: for each first word its sorted second words with counts, dealt by the first word. First words with a large
  share of all tokens (HOT_SHARE) are dealt by both words;
* trigrams, dealt as their first two words are: by rank of that bigram in its part, the sorted third words with counts;
  where these are many, how many occur once and twice;
* lower orders: how many different words stand before a bigram (one after the begin: its count) and before a word, and
  how many second words of a first word have such a number of one, two, more.

A text is begin, words, end; its first token has the begin alone as context. Map tasks sort and count what they see
and send delta-coded blocks, one for each part; so what is shuffled is a few bytes for each different n-gram of a task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import columns_or_null, give_back, load, new_path, posix, save, slices, words

#: Input bytes to a part of the words, and of the bigrams.
WORD_PART, PAIR_PART = 64 << 20, 16 << 20
#: Keys a map task holds before it counts them.
HELD = 4_000_000
#: A first word with over 1 / (HOT_SHARE * parts) of all tokens is dealt by both words.
HOT_SHARE = 4
#: Third words of a bigram whose counts are looked through when asked; for more it is kept how many occur once and twice.
FEW = 8
#: Files a scoring task holds mapped at a time; Linux allows 65,530 maps a process.
OPEN = 48_000
#: Tasks that merge parts, at most; beyond that a task merges several, one after the other.
MERGERS = 20_000


@dataclass
class Model:
    """Where the arrays are, and the totals: a few numbers for each part."""

    path: str
    bits: int
    pairs: int
    sizes: list[int]
    tokens: int
    docs: int
    hot: list[int] = field(default_factory=list)
    hot_follow: dict[int, tuple[int, ...]] = field(default_factory=dict)
    end_before: int = 0
    kinds: int = 0
    top_discount: tuple[float, ...] = (0.5, 0.5, 0.5)
    discount: tuple[float, ...] = (0.5, 0.5, 0.5)
    low_discount: tuple[float, ...] = (0.5, 0.5, 0.5)
    low_rest: float = 1.0

    @property
    def words(self) -> int:
        return sum(self.sizes)

    @property
    def vocabulary(self) -> int:
        """Distinct training tokens, the end among them."""
        return self.words + bool(self.docs)

    @property
    def start(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)


def discounts(n: np.ndarray) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts from how many n-grams occur 1, 2, 3 and 4 times; 1/2 where one is missing."""
    if not n[:4].all():
        return (0.5, 0.5, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)) for k in (1, 2, 3))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and their counts summed. What is given is sorted in place, so that it isn't held twice."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys[:], counts[:] = keys[order], counts[order]
        del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, byte planes apart, compressed: the upper planes of small numbers cost nothing."""
    plane = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.compress(plane, codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(blob, 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).reshape(-1)


BLOCK = "part int, n bigint, keys binary, counts binary, thirds binary"


def blocks(part: np.ndarray, keys: np.ndarray, counts: np.ndarray, thirds: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each part: keys, which come sorted, as deltas, and counts; for trigrams the third words too."""
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order], counts[order]
    thirds = None if thirds is None else thirds[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else [0]
    for a, b in zip(cut, cut[1:], strict=False):
        k = keys[a:b].astype(np.uint64)
        row = [[int(part[a])], [int(b - a)], [pack(np.diff(k, prepend=np.uint64(0)))], [pack(counts[a:b])], [None if thirds is None else pack(thirds[a:b])]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["part", "n", "keys", "counts", "thirds"])


def unblocked(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    give_back()
    sizes = table.column("n").to_pylist()
    keys = np.empty(sum(sizes), np.uint64)
    for k, n, end in zip(table.column("keys"), sizes, np.cumsum(sizes), strict=True):
        np.cumsum(unpack(k.as_py(), n), out=keys[end - n : end])
    counts = np.concatenate([narrow(unpack(c.as_py(), n)) for c, n in zip(table.column("counts"), sizes, strict=True)])
    return table.column("part")[0].as_py(), keys, counts


def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    part, keys, counts = unblocked(table)
    return (part, *counted(keys, counts))


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def capped(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those of 255 and more by position."""
    many = np.flatnonzero(n >= 255)
    return {"seen": np.minimum(n, 255).astype(np.uint8), "many": np.stack([many, n[many]])}


def uncapped(got: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    n = got["seen"][at].astype(np.int64)
    big = np.flatnonzero(n == 255)
    n[big] = got["many"][1][np.searchsorted(got["many"][0], at[big])]
    return n


def hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different words' hashes, and for each word which one it is."""
    coded = flat.dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary.cast(pa.binary())), np.uint64, len(coded.dictionary))
    return h, coded.indices.to_numpy()


def word_counts(bits: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, tokens, docs = np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0
        held: list = []
        for batch in batches:
            for b in slices(batch, "text"):
                flat, per = words(b.column("text"))
                h, at = hashes(flat)
                held.append((h, np.bincount(at, minlength=len(h))))
                tokens, docs = tokens + len(flat), docs + len(per)
                if sum(len(x) for x, _ in held) > HELD // 4:
                    keys, counts = counted(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(x for _, x in held)]))
                    held = []
        keys, counts = counted(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([counts, *(x for _, x in held)]))
        yield from blocks((keys >> np.uint64(64 - bits)).astype(np.int64), keys, counts)
        # the totals travel as a part of their own
        yield from blocks(np.full(2, 1 << bits), np.array([0, 1], np.uint64), np.array([tokens, docs]))

    return count


def word_part(path: str, bits: int, most: int) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        part, keys, counts = merged(table)
        often: list[list[int]] = []
        if part < 1 << bits:
            save(path, f"word-{part}", word=keys, times=narrow(counts))
            top = np.flatnonzero(counts * most > counts.sum())
            often = [[int(i), int(counts[i])] for i in top]
            return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "tokens": pa.array([0], pa.int64()), "docs": pa.array([0], pa.int64()), "often": pa.array([often], pa.list_(pa.list_(pa.int64())))})
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([0], pa.int64()), "tokens": [int(counts[0])], "docs": [int(counts[1])], "often": pa.array([[]], pa.list_(pa.list_(pa.int64())))})

    return write


class Words:
    """Ids, counts and continuations of words by their hashes."""

    def __init__(self, m: Model, *extra: str):
        path = posix(m.path)
        self.start, self.shift = m.start, np.uint64(64 - m.bits)
        none = {"word": np.empty(0, np.uint64)} | {k: np.empty(0, np.int64) for k in extra}
        parts = [load(path, f"word-{p}") | ((load(path, f"before-{p}") if "before" in extra else None) or {}) if n else none for p, n in enumerate(m.sizes)]
        self.word = [got["word"] for got in parts]
        self.extra = {k: [got[k] for got in parts] for k in extra}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids, -1 for words that aren't there, and the extra arrays' values, 0 for those."""
        ids, got = np.full(len(h), -1, np.int64), {k: np.zeros(len(h), np.int64) for k in self.extra}
        part = (h >> self.shift).astype(np.int64)
        order = np.argsort(h)
        cut = np.searchsorted(part[order], np.arange(len(self.word) + 1))
        for p, word in enumerate(self.word):
            mine = order[cut[p] : cut[p + 1]]
            if not len(mine) or not len(word):
                continue
            at = np.minimum(np.searchsorted(word, h[mine]), len(word) - 1)
            there = word[at] == h[mine]
            mine, at = mine[there], at[there]
            ids[mine] = at + self.start[p]
            for k, v in self.extra.items():
                got[k][mine] = v[p][at]
        return ids, got


def sequences(ids: np.ndarray, per: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, text) of all bigrams: begin, words, end. V is the end's id and V + 1 the begin's."""
    text = np.repeat(np.arange(len(per)), per + 1)
    stop = np.cumsum(per + 1) - 1
    second = np.empty(len(text), np.int64)
    is_word = np.ones(len(text), bool)
    is_word[stop] = False
    second[is_word], second[stop] = ids, m.words
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[stop - per] = m.words + 1
    return first, second, text


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_parts(first: np.ndarray, second: np.ndarray, m: Model) -> np.ndarray:
    """A bigram's part: by its first word, by both if that is a hot one."""
    hot = np.isin(first, np.array(m.hot, np.int64))
    return (mixed(np.where(hot, first * np.int64(m.words + 2) + second, first)) % np.uint64(m.pairs)).astype(np.int64)


def pair_counts(m: Model) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words(m)
        keys, counts, held, rows = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        width = np.int64(m.words + 2)

        def reduce() -> tuple[np.ndarray, np.ndarray]:
            new = counted(np.concatenate(held)) if held else (np.empty(0, np.int64),) * 2
            held.clear()
            give_back()
            return counted(np.concatenate([keys, new[0]]), np.concatenate([counts, new[1]]))

        for batch in batches:
            for b in slices(batch, "text"):
                flat, per = words(b.column("text"))
                h, at = hashes(flat)
                first, second, _ = sequences(vocabulary.find(h)[0][at], per, m)
                held.append(first * width + second)
                rows += len(first)
                if rows > HELD:
                    keys, counts = reduce()
                    rows = 0
        keys, counts = reduce()
        yield from blocks(pair_parts(keys // width, keys % width, m), keys, counts)

    return count


def pair_part(m: Model) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        part, keys, counts = merged(table)
        first, width = keys // np.uint64(m.words + 2), np.uint64(m.words + 2)
        start = np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(keys))
        save(posix(m.path), f"pair-{part}", first=narrow(first[start[:-1]]), start=narrow(start), second=narrow(keys % width), **capped(counts))
        return pa.table({"part": pa.array([part], pa.int32()), "stats": pa.array([[len(keys)]], pa.list_(pa.int64()))})

    return write


def pair_keys(pairs: dict[str, np.ndarray], m: Model) -> np.ndarray:
    """The sorted keys first * (V + 2) + second of a part."""
    return np.repeat(pairs["first"].astype(np.uint64), np.diff(pairs["start"].astype(np.int64))) * np.uint64(m.words + 2) + pairs["second"]


def triple_counts(m: Model) -> Callable:
    """Trigrams as (key of the first two words, third word), dealt as those two are. Sent off whenever HELD are there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = Words(m), np.int64(m.words + 2)
        held: list = []

        def sent() -> Iterator[pa.RecordBatch]:
            pairs, thirds = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            some, key = np.unique(pairs, return_inverse=True)
            del pairs
            key *= width
            key += thirds
            del thirds
            key, n = counted(key)
            pair = some[key // width]
            give_back()
            yield from blocks(pair_parts(pair // width, pair % width, m), pair, n, key % width)

        for batch in batches:
            for b in slices(batch, "text"):
                flat, per = words(b.column("text"))
                h, at = hashes(flat)
                first, second, _ = sequences(vocabulary.find(h)[0][at], per, m)
                inner = np.flatnonzero(first[1:] != m.words + 1)
                held.append((first[inner] * width + second[inner], second[inner + 1]))
                if sum(len(x) for x, _ in held) > HELD:
                    yield from sent()
        if held:
            yield from sent()

    return count


def triple_part(m: Model) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        path, width = posix(m.path), np.uint64(m.words + 2)
        part, key, n = unblocked(table)
        own, end = pair_keys(load(path, f"pair-{part}"), m), 0
        for t, k in zip(table.column("thirds"), table.column("n").to_pylist(), strict=True):
            some = slice(end, end := end + k)
            key[some] = np.searchsorted(own, key[some]).astype(np.uint64) * width + unpack(t.as_py(), k)
        key, n = counted(key, n)
        at = (key // width).astype(np.int64)
        start = np.searchsorted(at, np.arange(len(own) + 1))
        many = np.flatnonzero(np.diff(start) > FEW)
        once, twice = (np.bincount(at[n == k], minlength=len(own))[many] for k in (1, 2))
        save(path, f"triple-{part}", third=narrow(key % width), start=narrow(start), long=narrow(many), once=narrow(once), twice=narrow(twice), **capped(n))
        row = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"part": pa.array([part], pa.int32()), "stats": pa.array([row], pa.list_(pa.int64()))})

    return write


def extensions(m: Model) -> Callable:
    """From each part of the trigrams: how many of them end in each bigram, dealt as the bigrams are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, width = posix(m.path), np.int64(m.words + 2)
        for batch in batches:
            for p in batch.column("part").to_pylist():
                pairs, got = load(path, f"pair-{p}"), load(path, f"triple-{p}")
                if pairs is None:
                    continue
                # a count of 0, so that every part of the bigrams is merged
                own = pair_keys(pairs, m)
                yield from blocks(np.array([p]), own[:1], np.zeros(1, np.int64))
                if got is not None:
                    middle = np.repeat(pairs["second"].astype(np.int64), np.diff(got["start"].astype(np.int64)))
                    key, n = counted(middle * width + got["third"].astype(np.int64))
                    yield from blocks(pair_parts(key // width, key % width, m), key, n)

    return count


#: For a first word: how many of its bigrams have one, two, more words before them, and the sum of all.
FOLLOW = ("one", "two", "more", "sum")


def extension_part(m: Model) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        path = posix(m.path)
        part, keys, n = merged(table)
        pairs = load(path, f"pair-{part}")
        first, start = pairs["first"].astype(np.int64), pairs["start"].astype(np.int64)
        before = np.zeros(start[-1], np.int64)
        before[np.searchsorted(pair_keys(pairs, m), keys)] = n
        for k in np.flatnonzero(first == m.words + 1):
            before[start[k] : start[k + 1]] = uncapped(pairs, np.arange(start[k], start[k + 1]))
        follow = [np.add.reduceat(x.astype(np.int64), start[:-1]) for x in (before == 1, before == 2, before >= 3, before)]
        save(path, f"follow-{part}", **{k: narrow(x) for k, x in zip(FOLLOW, follow, strict=True)}, **capped(before))
        hot = np.flatnonzero(np.isin(first, np.array(m.hot, np.int64)))
        rows = [[int(first[i]), *(int(x[i]) for x in follow)] for i in hot]
        rows.append([-1, *(int((before == k).sum()) for k in (1, 2, 3, 4))])
        return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "stats": pa.array(rows, pa.list_(pa.int64()))})

    return write


def continuations(m: Model) -> Callable:
    """From each part of the bigrams: how many of its bigrams end in each word, dealt as the words are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, start = posix(m.path), m.start
        for batch in batches:
            for p in batch.column("part").to_pylist():
                pairs = load(path, f"pair-{p}")
                if pairs is None:
                    continue
                second, n = counted(pairs["second"].astype(np.int64))
                yield from blocks(np.searchsorted(start, second, "right") - 1, second, n)

    return count


def continuation_part(m: Model) -> Callable:
    def write(table: pa.Table) -> pa.Table:
        part, ids, n = merged(table)
        if part < len(m.sizes):
            dense = np.zeros(m.sizes[part], np.int32)
            dense[ids.astype(np.int64) - m.start[part]] = n
            save(posix(m.path), f"before-{part}", before=narrow(dense))
        row = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 2).sum()), int(n.sum()) if part == len(m.sizes) else 0]
        return pa.table({"part": pa.array([part], pa.int32()), "stats": pa.array([row], pa.list_(pa.int64()))})

    return write


def train(docs: DataFrame) -> Model:
    """Counts all of docs (column text) into a model. Null texts count as empty; an empty table gives a model of nothing."""
    spark = docs.sparkSession
    docs = columns_or_null(docs, text="string")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # the planner doesn't know
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (max(1, size // WORD_PART) - 1).bit_length())
    m = Model(new_path(spark, "ngrams"), bits, max(8, size // PAIR_PART), [0] * (1 << bits), 0, 0)
    share = HOT_SHARE * m.pairs
    found = docs.mapInArrow(word_counts(bits), BLOCK).groupBy("part").applyInArrow(word_part(posix(m.path), bits, share), "part int, n bigint, tokens bigint, docs bigint, often array<array<bigint>>").collect()
    for r in found:
        if r.part < 1 << bits:
            m.sizes[r.part] = r.n
        else:
            m.tokens, m.docs = r.tokens + r.docs, r.docs
    start = m.start
    m.hot = sorted([int(start[r.part]) + i for r in found for i, n in r.often if n * share > m.tokens] + [m.words + 1] * (m.docs * share > m.tokens))
    if not m.docs:
        return m
    tasks = min(m.pairs, MERGERS)
    ranges = spark.range(m.pairs).select(F.col("id").cast("int").alias("part")).repartition(min(m.pairs, 4 * spark.sparkContext.defaultParallelism))

    def merge(df: DataFrame, step: Callable, part: Callable) -> DataFrame:
        return df.mapInArrow(step(m), BLOCK).repartition(tasks, "part").groupBy("part").applyInArrow(part(m), "part int, stats array<bigint>")

    def sums(n: int) -> list[Column]:
        return [F.sum(F.col("stats").getItem(k)) for k in range(n)]

    m.kinds = merge(docs, pair_counts, pair_part).agg(*sums(1)).first()[0]
    m.top_discount = discounts(np.array([x or 0 for x in merge(docs, triple_counts, triple_part).agg(*sums(4)).first()]))
    stats = merge(ranges, extensions, extension_part).select(F.col("stats")[0].alias("first"), *[F.col("stats").getItem(k).alias(f"s{k}") for k in range(1, 5)])
    total = {r[0]: list(r[1:]) for r in stats.groupBy("first").agg(*[F.sum(f"s{k}") for k in range(1, 5)]).collect()}
    m.discount = discounts(np.array(total.pop(-1)))
    m.hot_follow = {k: tuple(v) for k, v in total.items()}
    n1, n2, n3, n4, n3p, m.end_before = ranges.mapInArrow(continuations(m), BLOCK).groupBy("part").applyInArrow(continuation_part(m), "part int, stats array<bigint>").agg(*sums(6)).first()
    d = m.low_discount = discounts(np.array([n1, n2, n3, n4]))
    m.low_rest = (d[0] * n1 + d[1] * n2 + d[2] * n3p) / m.kinds
    return m


def within(a: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands, or would, in the sorted run a[low:high]."""
    low, end = low.copy(), high.copy()
    todo = np.flatnonzero(low < end)
    while len(todo):
        mid = (low[todo] + end[todo]) >> 1
        less = a[mid] < x[todo]
        low[todo[less]] = mid[less] + 1
        end[todo[~less]] = mid[~less]
        todo = todo[low[todo] < end[todo]]
    return low


class Grams:
    """Counts of bigrams and trigrams, and the mass that their contexts leave to others, from the memory-mapped parts."""

    def __init__(self, m: Model):
        self.m, self.path, self.open = m, posix(m.path), OrderedDict()

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            self.open[name] = load(self.path, name)
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def parts(self, part: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.lexsort((key, part))
        cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])), len(part)) if len(part) else [0]
        for a, b in zip(cut, cut[1:], strict=False):
            yield int(part[order[a]]), order[a:b]

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each bigram's part, rank in it (-1: not there), count, number of words before it; its first word's sum of such numbers and mass left."""
        m, d = self.m, np.array(self.m.discount)
        key, part = first * np.int64(m.words + 2) + second, pair_parts(first, second, m)
        rank = np.full(len(key), -1, np.int64)
        count, before, led = (np.zeros(len(key), np.int64) for _ in range(3))
        rest = np.zeros(len(key))
        for p, mine in self.parts(part, key):
            pairs, lower = self.file(f"pair-{p}"), self.file(f"follow-{p}")
            if pairs is None:
                continue
            firsts = pairs["first"]
            at = np.minimum(np.searchsorted(firsts, first[mine].astype(firsts.dtype)), len(firsts) - 1)
            there = firsts[at] == first[mine]
            mine, at = mine[there], at[there]
            follow = [lower[k][at].astype(np.int64) for k in FOLLOW]
            rest[mine], led[mine] = d @ follow[:3], follow[3]
            low, high = (pairs["start"][at + k].astype(np.int64) for k in (0, 1))
            at = within(pairs["second"], low, high, second[mine])
            there = at < high
            there[there] = pairs["second"][at[there]] == second[mine[there]]
            mine, at = mine[there], at[there]
            rank[mine], count[mine], before[mine] = at, uncapped(pairs, at), uncapped(lower, at)
        for h in m.hot:  # dealt over all parts
            follow = np.array(m.hot_follow.get(h, (0, 0, 0, 0)))
            rest[first == h], led[first == h] = d @ follow[:3], follow[3]
        return part, rank, count, before, led, rest

    def triples(self, part: np.ndarray, rank: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each trigram's count, given its first two words' part and rank, and the mass those leave."""
        count, rest = np.zeros(len(part), np.int64), np.zeros(len(part))
        d = self.m.top_discount
        for p, mine in self.parts(part, rank):
            got = self.file(f"triple-{p}")
            if got is None:
                continue
            low, high = (got["start"][rank[mine] + k].astype(np.int64) for k in (0, 1))
            once, twice = np.zeros((2, len(mine)), np.int64)
            short = high - low <= FEW
            for k in range(FEW):
                some = np.flatnonzero(short & (low + k < high))
                n = got["seen"][low[some] + k]
                once[some], twice[some] = once[some] + (n == 1), twice[some] + (n == 2)
            if not short.all():
                at = np.searchsorted(got["long"], rank[mine[~short]].astype(got["long"].dtype))
                once[~short], twice[~short] = got["once"][at], got["twice"][at]
            rest[mine] = d[0] * once + d[1] * twice + d[2] * (high - low - once - twice)
            at = within(got["third"], low, high, third[mine])
            there = at < high
            there[there] = got["third"][at[there]] == third[mine[there]]
            count[mine[there]] = uncapped(got, at[there])
        return count, rest


def discounted(n: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


def score_with(m: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, grams = Words(m, *(("times", "before") if m.kinds else ())), Grams(m)
        floor = 1.0 / (m.vocabulary + 1)
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                flat, per = words(b.column("text"))
                h, at = hashes(flat)
                ids, got = vocabulary.find(h)
                zero = np.zeros(len(h), np.int64)
                first, second, text = sequences(ids[at], per, m)
                end = second == m.words
                times, before = (np.empty(len(second), np.int64) for _ in range(2))
                for out, name, last in ((times, "times", m.docs), (before, "before", m.end_before)):
                    out[~end], out[end] = got.get(name, zero)[at], last
                low = np.maximum(discounted(before, m.low_discount), 0) / max(m.kinds, 1) + m.low_rest * floor
                p = low.copy()
                known = np.flatnonzero(first >= 0) if m.docs else np.empty(0, np.int64)
                if len(known):
                    width, new = np.int64(m.words + 2), second < 0
                    some, back = np.unique(first[known] * width + np.maximum(second[known], 0), return_inverse=True)
                    part, rank, count, ahead, led, rest = grams.pairs(some // width, some % width)
                    n = np.where(new[known], 0, ahead[back])
                    p[known] = (np.maximum(discounted(n, m.discount), 0) + rest[back] * low[known]) / led[back]
                    # the bigram before is the context: all of its occurrences but those at the end go on
                    pair = np.full(len(second), -1, np.int64)
                    pair[known] = np.where(new[known] | (rank[back] < 0), -1, back)
                    top = 1 + np.flatnonzero((first[1:] != m.words + 1) & (pair[:-1] >= 0))
                    some, back = np.unique(pair[top - 1] * width + np.maximum(second[top], 0), return_inverse=True)
                    context = some // width
                    n, rest = grams.triples(part[context], rank[context], some % width)
                    n = np.where(new[top], 0, n[back])
                    p[top] = (np.maximum(discounted(n, m.top_discount), 0) + rest[back] * p[top]) / count[context][back]
                start = np.cumsum(per + 1) - per - 1
                base = np.log10((times + 1) / (m.tokens + m.vocabulary + 1))
                n = len(per)
                add = lambda x: np.add.reduceat(x, start) if n else np.empty(0, x.dtype)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(per + 1), pa.array(add((times > 0).astype(np.int64))), pa.array(np.full(n, m.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def scores(docs: DataFrame, m: Model) -> DataFrame:
    """A row for each row of docs: its number of tokens, known ones, base and model log10 probability.

    Null texts count as empty: the end alone. Repeated rows score alike; held_out is passed on.
    """
    docs = columns_or_null(docs, doc_id="bigint", held_out="boolean", text="string")
    return docs.mapInArrow(score_with(m), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as empty text); scores all."""
    docs = columns_or_null(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    return scores(docs, train(docs.where(~F.col("held_out"))))


common.ship(__name__)
