"""SimHash near-duplicates (operator 9): bit-sliced comparison of fingerprints.

A fingerprint's 64 bits are taken over 4-word shingles (see `fingerprints`). Equal fingerprints are one node.
For the others, the 64 bits are cut into 6 blocks; within 4 differing bits, two blocks at least agree, so each
pair of blocks (15) is a key under which all partners meet. The rows of a key are compared bit-sliced: 64
candidates to a machine word and one word row per bit plane, distances kept in carry-save counters for a whole
block of queries, and a block is abandoned as soon as every counter has passed the radius. Links leave a task as
a spanning forest. Keys with more than HOT rows are cut into segments and each pair of segments is a task.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Table, columns_or_null, components, drop_path, new_path, posix, spanning

RADIUS = 4
#: Bits of the 6 blocks; any 2 of them make a key of 21 or 22 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Rows of a key above which its comparison is dealt over several tasks.
HOT = 20_000
#: Fingerprints compared against one another at a time: candidates of 16 words.
SLICE = 1024


def shingle_hashes(text: str, width: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of an already lower-cased text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    start = np.concatenate([[0], end[:-1] + 1])[:n].tolist()
    stop = end[min(width, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], 42) for a, b in zip(start, stop, strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; zero of none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lower = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
        fp = np.array([majority(shingle_hashes(t.as_py())) for t in lower], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row for each row of docs, the fingerprint as a signed long. Null text counts as empty."""
    return columns_or_null(docs, doc_id="bigint", text="string").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def bits_of(fp: np.ndarray) -> np.ndarray:
    """(fingerprints, bits) of fingerprints of one 64-bit word each, or of rows of several."""
    wide = np.ascontiguousarray(fp.reshape(len(fp), -1))
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: (bits, words), candidate i at bit i % 64 of word i // 64."""
    bits = bits_of(fp)
    pad = np.zeros((bits.shape[1], -(-len(fp) // 64) * 64), np.uint8)
    pad[:, : len(fp)] = bits.T
    return np.packbits(pad, axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, vertical: np.ndarray, n: int, order: list[int], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) within the radius. vertical: the candidates' planes; order: of the planes.

    The counters are the bits of each distance, `width` of them, and one that stays set once the radius is passed.
    Three planes go through a full adder to one word of weight 1 and one of weight 2.
    """
    width = (radius + 1).bit_length()
    alive, words = np.arange(len(queries)), vertical.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    flip = np.where(bits_of(queries), full, np.uint64(0))
    # half of the bits of strangers differ: about here their counters pass the radius
    stops = {3 * (k // 3) for k in (2 * radius + 4, 2 * radius + 12, 3 * radius + 6, 3 * radius + 16, 4 * radius + 24) if k < len(order)}
    count = [np.zeros((len(queries), words), np.uint64) for _ in range(width)]
    over = np.zeros((len(queries), words), np.uint64)
    if n % 64:
        over[:, -1] = full << np.uint64(n % 64)

    def add(x: np.ndarray, weight: int) -> None:
        for k in range(weight, width):
            carry = count[k] & x
            count[k] ^= x
            x = carry
        np.bitwise_or(over, x, out=over)

    def passed() -> np.ndarray:
        """Counters above the radius, from the top bit down."""
        more, same = np.zeros_like(over), np.full_like(over, full)
        for k in reversed(range(width)):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more

    for at in range(0, len(order), 3):
        diff = [vertical[b][None, :] ^ flip[alive, b][:, None] for b in order[at : at + 3]]
        if len(diff) == 3:
            a, b, c = diff
            half = a ^ b
            add(half ^ c, 0)
            add((a & b) | (half & c), 1)
        else:
            for x in diff:
                add(x, 0)
        if at in stops:
            over |= passed()
            live = (over != full).any(1)
            if not live.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if live.mean() < 0.7:
                alive, over, count = alive[live], over[live], [c[live] for c in count]
    hit = ~(over | passed())
    q, w = np.nonzero(hit)
    bits = np.unpackbits(hit[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return alive[q[r]], w[r] * 64 + c


def plane_order(key: int) -> list[int]:
    """Bits outside the key's two blocks first: those inside agree anyway."""
    pair = list(combinations(range(6), 2))[key]
    inside = [b for k in pair for b in range(BLOCKS[k][0], sum(BLOCKS[k]))]
    return [b for b in range(64) if b not in inside] + inside


def taken(label: np.ndarray, i: np.ndarray, j: np.ndarray, same: Callable[[int, int], bool]) -> np.ndarray:
    """Places of the pairs of rows (i ascending) that `same` takes; pairs that are one component by then aren't asked for."""
    names, back = np.unique(label[np.concatenate([i, j])], return_inverse=True)
    root, x, y, out = np.arange(len(names)), back[: len(i)], back[len(i) :], []
    for rest in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
        while len(rest := rest[root[x[rest]] != root[y[rest]]]):
            at, rest = int(rest[0]), rest[1:]
            if same(int(i[at]), int(j[at])):
                out.append(at)
                low, high = sorted((int(root[x[at]]), int(root[y[at]])))
                root[root == high] = low
    return np.array(out, np.int64)


def link_sorted(key: np.ndarray, fp: np.ndarray, order_of: Callable[[int], list[int]], radius: int = RADIUS, size: int | None = None, same: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) among fingerprints sorted by key; all rows of a key are here.

    Slices of the sequence are compared with themselves and, while a key runs on, with the slices after.
    Slices whose members are one component by then are skipped: no comparison could change anything.
    same: an exact check of two rows that must follow before they are linked.
    """
    n, size = len(fp), size or SLICE
    label = np.arange(n)
    cut = list(range(0, n, size)) + [n]
    made = [planes(fp[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    for s in range(len(made)):
        a, b = cut[s], cut[s + 1]
        for t in range(s, len(made)):
            c, d = cut[t], cut[t + 1]
            if t > s:
                if key[c] != key[b - 1]:
                    break
                a = int(np.searchsorted(key[:b], key[c], "left")) if key[a] != key[c] else a
                stop = c + int(np.searchsorted(key[c:d], key[c], "right"))
                if (label[a:b] == label[a]).all() and (label[c:stop] == label[a]).all():
                    continue
            i, j = near(fp[a:b], made[t], d - c, order_of(int(key[c])), radius)
            i, j = i + a, j + c
            live = np.flatnonzero(label[i] != label[j])
            if same and live.size:
                live = live[taken(label, i[live], j[live], same)]
            if live.size:
                i, j = label[i[live]], label[j[live]]
                nodes, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                node, low = spanning(back[: len(i)], back[len(i) :], len(nodes))
                to = np.arange(n)
                to[nodes[node]] = nodes[low]
                label = to[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def grouped(batches: Iterator[pa.RecordBatch], most: int, columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Rows that arrive sorted by (key, seg), in runs of whole groups with about `most` rows, groups of one row left out."""
    held: list[list] = []
    seen, rows = None, 0

    def run(parts: list[list]) -> list[np.ndarray] | None:
        got = [np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for y in x for v in y] for x in zip(*parts, strict=True)]
        key, seg = got[:2]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])]))
        size = np.diff(np.append(first, len(key)))
        keep = np.repeat(size > 1, size)
        number = np.repeat(np.arange(len(first)), size)
        return [key[keep], number[keep], *[np.array(x, dtype=object)[keep] if isinstance(x, list) else x[keep] for x in got[2:]]] if keep.any() else None

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        if rows > most and (fresh := np.flatnonzero((cols[0] != seen[0]) | (cols[1] != seen[1]))).size:
            at = fresh[0]
            held.append([c[:at] for c in cols])
            if (out := run(held)) is not None:
                yield out
            held, rows, cols = [], 0, [c[at:] for c in cols]
        held.append(cols)
        seen, rows = (cols[0][-1], cols[1][-1]), rows + len(cols[0])
    if held and (out := run(held)) is not None:
        yield out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = [plane_order(k) for k in range(15)]
    for key, number, fp in grouped(batches, 200_000, ("key", "seg", "fp")):
        # a number for each (key, segment pair), with the pair of blocks in front
        a, b = link_sorted((key >> 22 << 22) + number % (1 << 22), fp.view(np.uint64), lambda k: orders[k >> 22])
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])


def segments(rows: DataFrame, by: str) -> DataFrame:
    """rows with a column seg: keys with over HOT rows are cut by `by`, and each pair of their segments is a group of its own."""
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    dealt = rows.join(hot, "key", "left").withColumn("mine", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(by), F.col("parts"))).cast("int"))
    seg = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("mine")).cast("bigint") * F.col("parts") + F.greatest(o, F.col("mine")))
    )
    return dealt.select(*rows.columns, F.explode(seg).alias("seg"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column fp) within RADIUS bits."""
    keys = []
    for k, (x, y) in enumerate(combinations(BLOCKS, 2)):
        part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in (x, y)]
        keys.append(F.lit(k << 22).cast("bigint") + F.shiftleft(part[0], y[1]) + part[1])
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments(rows, "fp").repartition(n, "key", "seg").sortWithinPartitions("key", "seg").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row (doc_id, fingerprint, component_id) for each row of docs.

    component_id: the smallest doc_id reached over links of RADIUS bits or fewer, by fingerprints. Empty and null
    texts have fingerprint zero and link like any other; repeated rows share a fingerprint and so a component; a
    null doc_id is never a component's name unless the component has no other. An empty table gives no rows.
    """
    each = Table(fingerprints(docs), "fingerprints").df
    fps = Table(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps").df
    comp = components(links(fps.select("fp")))
    named = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    label = named.join(lowest(named), "component").select("fp", F.col("first").alias("component_id"))
    return each.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words to a shingle of similar documents.
WIDTH = 5
#: Shingles are counted over all documents by BUCKETS of their hashes, which travel in pieces of BUCKETS / PIECES. Bits of a set's parity, as 64-bit words.
BUCKETS, PIECES, PARITY = 1 << 20, 16, 16
#: Pairs a task remembers as unlike. Bits of a place in a file of sets.
UNLIKE, PLACE = 1 << 20, 36
#: A set's fingerprint has 256 bits, words of 64; each word is cut into blocks of these bits, and each block is a key. Sets 0.8 alike differ
#: in 39 bits on average (standard deviation 6), strangers in 128: sets within WIDE_RADIUS are compared themselves.
WORDS, CUTS, WIDE_RADIUS = 4, (13, 13, 13, 13, 12), 64


def alike(both: int, a: int, b: int) -> bool:
    """Whether sets of a and b shingles with `both` in common are 0.8 alike or more, in whole numbers."""
    return 9 * both >= 4 * (a + b)


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles of an already lower-cased text, ascending."""
    return np.unique(shingle_hashes(text, WIDTH))


def parity(shingles: np.ndarray) -> np.ndarray:
    """PARITY words: a bit says whether an odd number of shingles fall on it. Two sets differ in as many shingles as bits, at least."""
    odd = np.bincount((shingles % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """64 more bits of each hash (splitmix64) for each k; the hashes themselves for 0."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """The SimHash of a set: WORDS words, as signed longs, each the majority of 64 bits of all distinct shingles."""
    return np.array([majority(mixed(shingles, k)) for k in range(WORDS)], np.uint64).view(np.int64).tolist()


FINGERPRINT = [f"f{k}" for k in range(WORDS)]
SETS = "doc_id bigint, text_hash bigint, digest binary, node bigint, piece int, counts binary, " + ", ".join(f"{f} bigint" for f in FINGERPRINT)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _write_sets(folder: str) -> Callable:
    """Each document's set goes to a file of the task's attempt: size, parity, shingles. node: attempt << PLACE | place in words.

    So rows that an attempt returns name its own file, whatever other attempts write. After a row for each document comes one for each piece of the partition's shingle counts by bucket.
    """

    def rows(**columns: list) -> pa.RecordBatch:
        n = max(len(c) for c in columns.values())
        types = {"doc_id": pa.int64(), "text_hash": pa.int64(), "digest": pa.binary(), "node": pa.int64(), "piece": pa.int32(), "counts": pa.binary()} | {f: pa.int64() for f in FINGERPRINT}
        return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns.get(k, [None] * n), t) for k, t in types.items()], list(types))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        own, at = TaskContext.get().taskAttemptId(), 0
        seen = np.zeros(BUCKETS, np.int64)
        with open(f"{folder}/{own}.bin", "wb") as f:
            for b in batches:
                lower, digest, node, fp, held, many = pc.ascii_lower(pc.fill_null(b.column("text"), "")), [], [], [], [], 0
                for t in lower:
                    s = shingle_set(t.as_py())
                    f.write(np.concatenate([np.array([len(s)], np.uint64), parity(s), s]).tobytes())
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    fp.append(wide_fingerprint(s))
                    node.append(own << PLACE | at)
                    at += 1 + PARITY + len(s)
                    held.append(bucket(s))
                    many += len(s)
                    if many > BUCKETS:
                        seen += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, many = [], 0
                if held:
                    seen += np.bincount(np.concatenate(held), minlength=BUCKETS)
                f.flush()
                yield rows(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), digest=digest, node=node, **{f: [x[k] for x in fp] for k, f in enumerate(FINGERPRINT)})
        yield rows(piece=list(range(PIECES)), counts=[pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for x in np.split(seen, PIECES)])

    return write


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    size = BUCKETS // PIECES
    for b in batches:
        for piece, blob in zip(b.column("piece").to_pylist(), b.column("counts"), strict=True):
            got = np.frombuffer(pa.decompress(blob.as_py(), 4 * size, codec="zstd", asbytes=True), np.uint32)
            total[piece] = total.get(piece, 0) + got.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])


class Sets:
    """Reads sets out of the files that tasks wrote, each by its node."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, OrderedDict()

    def words(self, node: int, skip: int, n: int) -> np.ndarray:
        part = node >> PLACE
        if part not in self.files:
            if len(self.files) >= 200:
                os.close(self.files.popitem(last=False)[1])
            self.files[part] = os.open(f"{self.folder}/{part}.bin", os.O_RDONLY)
        out, at, left = [], 8 * ((node & (1 << PLACE) - 1) + skip), 8 * n
        while left:
            got = os.pread(self.files[part], left, at)
            if not got:
                raise EOFError(f"set {node} is cut off")
            out.append(got)
            at, left = at + len(got), left - len(got)
        return np.frombuffer(b"".join(out), np.uint64)

    def head(self, node: int) -> np.ndarray:
        """The set's size and its parity."""
        return self.words(node, 0, 1 + PARITY)

    def shingles(self, node: int, n: int) -> np.ndarray:
        return self.words(node, 1 + PARITY, n)

    def close(self) -> None:
        for fd in self.files.values():
            os.close(fd)


class Alike:
    """The exact check that follows the fingerprints: whether the sets of two nodes are 0.8 alike or more."""

    def __init__(self, folder: str):
        self.sets, self.unlike, self.last = Sets(folder), set(), (None, None)

    def read(self, node: int, head: np.ndarray) -> np.ndarray:
        if self.last[0] != node:
            self.last = (node, self.sets.shingles(node, int(head[0])))
        return self.last[1]

    def __call__(self, a: int, b: int) -> bool:
        if a == b:
            return True
        pair = (min(a, b), max(a, b))
        if pair in self.unlike:
            return False
        x, y = self.sets.head(a), self.sets.head(b)
        m, n = int(x[0]), int(y[0])
        # sets 0.8 alike differ in a ninth of their sizes' sum at most
        if 5 * min(m, n) >= 4 * max(m, n) and 9 * int(np.bitwise_count(x[1:] ^ y[1:]).sum(dtype=np.int64)) <= m + n:
            if alike(len(np.intersect1d(self.read(a, x), self.sets.shingles(b, n), assume_unique=True)), m, n):
                return True
        if len(self.unlike) >= UNLIKE:
            self.unlike.clear()
        self.unlike.add(pair)
        return False


def _wide_links(folder: str) -> Callable:
    blocks = np.repeat(np.arange(WORDS * len(CUTS)), CUTS * WORDS).tolist()
    orders = [[b for b in range(64 * WORDS) if blocks[b] != k] + [b for b in range(64 * WORDS) if blocks[b] == k] for k in range(WORDS * len(CUTS))]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Alike(folder)
        for key, number, node, *words in grouped(batches, 200_000, ("key", "seg", "node", *FINGERPRINT)):
            fp, names = np.stack(words, axis=1).view(np.uint64), node.tolist()
            # a number for each (key, segment pair), with the block in front
            a, b = link_sorted((key >> max(CUTS) << 32) + number, fp, lambda k: orders[k >> 32], WIDE_RADIUS, same=lambda i, j: check(names[i], names[j]))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])
        check.sets.close()

    return link


def wide_links(nodes: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) found by fingerprints: sets that agree in a block are compared bit-sliced, and those within WIDE_RADIUS bits by themselves."""
    keys = []
    for f in FINGERPRINT:
        for k, n in enumerate(CUTS):
            keys.append(F.lit(len(keys) << max(CUTS)).cast("bigint") + F.shiftrightunsigned(f, sum(CUTS[:k])).bitwiseAND(F.lit((1 << n) - 1)))
    rows = nodes.select("node", *FINGERPRINT, F.explode(F.array(*keys)).alias("key"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments(rows, "node").repartition(n, "key", "seg").sortWithinPartitions("key", "seg").mapInArrow(_wide_links(folder), "a bigint, b bigint")


def prefix(shingles: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first shingles of a set in one order for all sets: by how often their bucket was seen, then by hash.

    Two sets 0.8 alike or more share one of these at least, whatever the order: n less 0.8 n, rounded up, and one.
    The order has common shingles last, so few sets meet under them.
    """
    n = len(shingles)
    return shingles[np.argsort(seen[bucket(shingles)], kind="stable")[: n - (4 * n + 4) // 5 + 1 if n else 0]]


def _prefixes(folder: str, seen: bytes) -> Callable:
    """common: whether a key's bucket was seen over HOT times, as that of each key of so many sets is."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, often = Sets(folder), np.frombuffer(seen, np.float32)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                nodes, labels = (b.column(c).slice(at, 1000).to_numpy() for c in ("node", "label"))
                made = [prefix(sets.shingles(v, int(sets.head(v)[0])), often) for v in nodes.tolist()]
                key, (node, label) = np.concatenate(made), (np.repeat(x, [len(k) for k in made]) for x in (nodes, labels))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(label), pa.array(often[bucket(key)] > HOT)], ["key", "node", "label", "common"])
        sets.close()

    return rows


def _alike_links(folder: str) -> Callable:
    """Links among the sets of each group, every pair that is not linked already (label: by fingerprints) decided by the sets themselves."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, root, unlike = Sets(folder), {}, set()

        def find(v: int) -> int:
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        for _, number, node, found in grouped(batches, 100_000, ("key", "seg", "node", "label")):
            a, b = [], []
            for v, up in set(zip(node[node != found].tolist(), found[node != found].tolist(), strict=True)):
                low, high = sorted((find(v), find(up)))
                if low != high:
                    root[high] = low
            for group in np.split(node, np.flatnonzero(np.diff(number)) + 1):
                if len({find(v) for v in group.tolist()}) == 1:
                    continue
                heads = np.stack([sets.head(v) for v in group.tolist()])
                order = np.argsort(heads[:, 0], kind="stable")
                names, size, odd = group[order].tolist(), heads[order, 0].astype(np.int64), heads[order, 1:]
                label = np.array([find(v) for v in names])
                for i in range(len(names) - 1):
                    stop = int(np.searchsorted(size, 5 * size[i] // 4, "right"))
                    near = np.flatnonzero(label[i + 1 : stop] != label[i]) + i + 1
                    # sets 0.8 alike differ in a ninth of their sizes' sum at most
                    near = near[9 * np.bitwise_count(odd[near] ^ odd[i]).sum(1, dtype=np.int64) <= size[near] + size[i]]
                    mine = None
                    for j in near.tolist():
                        pair = (min(names[i], names[j]), max(names[i], names[j]))
                        if label[j] == label[i] or pair in unlike:
                            continue
                        mine = sets.shingles(names[i], int(size[i])) if mine is None else mine
                        other = sets.shingles(names[j], int(size[j]))
                        if alike(len(np.intersect1d(mine, other, assume_unique=True)), int(size[i]), int(size[j])):
                            low, high = sorted((int(label[i]), int(label[j])))
                            root[high] = low
                            label[label == high] = low
                            a.append(names[i])
                            b.append(names[j])
                        else:
                            if len(unlike) >= UNLIKE:
                                unlike.clear()
                            unlike.add(pair)
            if len(root) >= UNLIKE:
                root.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        sets.close()

    return link


def rest_links(nodes: DataFrame, folder: str, seen: bytes) -> DataFrame:
    """Links (a, b) that fingerprints may have missed: sets of different components so far (label) that share a shingle of their prefixes."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nodes are few bytes for sets of many: dealt out anew, else one task would read all sets
    prefixes = Table(nodes.select("node", "label").repartition(n, "node").mapInArrow(_prefixes(folder, seen), "key bigint, node bigint, label bigint, common boolean"), "prefixes")
    rows = prefixes.df
    dealt = segments(rows.where("common").drop("common"), "node").unionByName(rows.where("not common").drop("common").withColumn("seg", F.lit(0).cast("bigint")))
    linked = Table(dealt.repartition(n, "key", "seg").sortWithinPartitions("key", "seg").mapInArrow(_alike_links(folder), "a bigint, b bigint"), "links")
    prefixes.drop()
    return linked.df


def similar_documents(docs: DataFrame) -> DataFrame:
    """A row (doc_id, text_hash, component_id, kept) for each row of docs: near duplicates whose sets of 5-word shingles are 0.8 alike or more.

    SimHash fingerprints of the sets find the pairs (`wide_links`), and a link is the similarity of the two sets. No number of bits holds all
    pairs at 0.8, so sets that fingerprints left apart meet under a shingle that both have in their prefix, too (`rest_links`). All in all
    exact up to equal hashes. The sets lie in files of the shared folder, which workers read. component_id is the smallest doc_id
    reached over links (null if no row there has one); kept marks the row of that id, of several the one with the smallest text_hash
    (xxhash64 of the text), and all rows equal to it in both. Documents without words are one group. Empty tables give no rows.
    """
    spark = docs.sparkSession
    folder_url = new_path(spark, "sets")
    folder = posix(folder_url)
    texts = columns_or_null(docs, doc_id="bigint", text="string").withColumn("text_hash", F.xxhash64("text"))
    made = Table(texts.mapInArrow(_write_sets(folder), SETS), "wide").df
    each = made.where("node is not null").select("doc_id", "text_hash", "digest", "node", *FINGERPRINT)
    me = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = Table(each.groupBy("digest").agg(F.min(me).alias("low"), F.min("node").alias("node"), *[F.min(f).alias(f) for f in FINGERPRINT]), "nodes").df
    pieces = made.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece").mapInArrow(_add_counts, "piece int, counts binary")
    seen = b"".join(r.counts for r in sorted(pieces.collect())) or bytes(4 * BUCKETS)
    near = Table(wide_links(nodes, folder), "links").df
    by_bits = nodes.select("node").join(components(near), "node", "left").select("node", F.coalesce("component", "node").alias("label"))
    found = components(near.unionByName(rest_links(by_bits, folder, seen)))
    drop_path(spark, folder_url)
    named = nodes.join(found, "node", "left").select("digest", "low", F.coalesce("component", "node").alias("component"))
    label = named.join(lowest(named), "component").select("digest", "first")
    return each.join(label, "digest").select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), (me == F.col("first")).alias("kept"))


def lowest(named: DataFrame) -> DataFrame:
    """(component, first): the least `low` of each. A table of its own, so that the join back to a large component's members can be split."""
    return Table(named.groupBy("component").agg(F.min("low").alias("first")), "names").df


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


common.ship(__name__)
