"""SentencePiece encoding and decoding (operator 5): a max-plus parallel scan over the chunks of giant documents.

A text of up to CHUNK characters is encoded as it is. A longer one is cut into chunks, and what one chunk passes to
the next is a boundary state: the piece that ends at the cut or reaches over it. For this model a sequence of pieces
is the encoding of its text exactly if every two neighbours are the encoding of theirs, so a chunk's transfer matrix
holds 0 where pieces lead from one state to another in this way and minus infinity elsewhere. The matrices of
a document are multiplied in the max-plus semiring, associatively; prefix and suffix products give the one state at each
cut that lies on a path of weight 0; then every chunk is traced back by itself. A cut between two characters that
stand side by side in no piece has a single state, and cuts are put there where one is near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Table, columns_or_null, slices

#: Where the model's file is; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters to a chunk, and how far after its nominal place a cut with one state is looked for.
CHUNK, SEARCH = 1 << 15, 1 << 10
#: Characters around a cut in which encodings from different states are expected to fall together.
SETTLE = 64
NEVER = -np.inf
#: Fixed value, appended to a serialised model: normalizer_spec { add_dummy_prefix: false }.
NO_PREFIX = b"\x1a\x02\x18\x00"


class Pieces:
    """A model without its dummy prefix, and what the cuts need of its vocabulary."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.vocabulary = {self.sp.id_to_piece(i) for i in plain}
        self.longest = max(map(len, self.vocabulary))
        self.neighbours = {p[i : i + 2] for p in self.vocabulary for i in range(len(p) - 1)}
        # a byte piece reads <0xNN>
        self.bytes = [bytes([int(self.sp.id_to_piece(i)[3:-1], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else self.sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.known: dict[tuple[str, str], bool] = {}

    def clean(self, s: str, at: int) -> bool:
        return s[at - 1 : at + 1] not in self.neighbours

    def split(self, s: str) -> list[str]:
        """Pieces of a normal string, as parts of it: the bytes of an unknown character together."""
        out, at, left = [], 0, 0
        for i in self.raw.encode(s):
            if left:
                left -= 1
                continue
            if self.sp.is_byte(i):
                size, left = 1, len(s[at].encode()) - 1
            else:
                size = len(self.sp.id_to_piece(i))
            out.append(s[at : at + size])
            at += size
        return out

    def fits(self, x: str, y: str) -> bool:
        """Whether x, y is the encoding of their text."""
        if x[-1] + y[0] not in self.neighbours:
            return True
        if (x, y) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[x, y] = self.split(x + y) == [x, y]
        return self.known[x, y]

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """Pieces [p, q) with p < at <= q that may stand at a cut; of a clean cut just the cut itself."""
        if at <= 0 or at >= len(s) or self.clean(s, at):
            return [(at, at)]
        found = [(p, q) for p in range(max(0, at - self.longest), at) for q in range(at, min(len(s), p + self.longest) + 1) if s[p:q] in self.vocabulary]
        return found if (at - 1, at) in found else [*found, (at - 1, at)]


def normal(text: str) -> str:
    return "▁" + text.replace(" ", "▁") if text else ""


def cuts(s: str, v: Pieces) -> list[int]:
    """Where a normal string is cut: at the first clean place from each nominal one, else there."""
    out = [0]
    while len(s) - out[-1] > CHUNK:
        at = out[-1] + CHUNK
        out.append(next((b for b in range(at, min(at + SEARCH, len(s) - 1)) if v.clean(s, b)), at))
    return [*out, len(s)]


class Chunk:
    """A chunk [a, b) of a normal string s, of which s may hold just the surroundings of the chunk."""

    def __init__(self, v: Pieces, s: str, a: int, b: int):
        self.v, self.s, self.a, self.b = v, s, a, b
        self.enter, self.leave = v.states(s, a), v.states(s, b)
        self.base: list[tuple[int, int]] | None = None

    def spans(self, u: int, w: int) -> list[tuple[int, int]]:
        out, at = [], u
        for p in self.v.split(self.s[u:w]) if w > u else []:
            out.append((at, at + len(p)))
            at += len(p)
        assert at == w, "the model changes the text"
        return out

    def path(self, u: int, w: int) -> list[tuple[int, int]]:
        """The encoding of s[u:w]. The first one is made in full; others differ from it near their ends, which is checked."""
        if self.base is None:
            self.base = self.spans(u, w)
            return self.base
        base = self.base
        if not base or w - u < 4 * SETTLE:
            return self.spans(u, w)
        if u == base[0][0]:
            head, rest = [], base
        else:
            k = next((k for k, (x, _) in enumerate(base) if x >= max(u, self.a) + SETTLE), None)
            head = self.spans(u, base[k][0]) if k is not None else []
            if not head or not self.fit(head[-1], base[k]):
                return self.spans(u, w)
            rest = base[k:]
        if w == base[-1][1]:
            return head + rest
        k = next((k for k in range(len(rest) - 1, -1, -1) if rest[k][1] <= min(w, self.b) - SETTLE), None)
        tail = self.spans(rest[k][1], w) if k is not None else []
        if not tail or not self.fit(rest[k], tail[0]):
            return self.spans(u, w)
        return head + rest[: k + 1] + tail

    def fit(self, x: tuple[int, int], y: tuple[int, int]) -> bool:
        return self.v.fits(self.s[slice(*x)], self.s[slice(*y)])

    def inner(self, i: int, j: int) -> list[tuple[int, int]] | None:
        """The pieces between entry state i and exit state j, None if no encoding passes both."""
        x, y = self.enter[i], self.leave[j]
        if x[1] > y[0]:
            return None
        mid = self.path(x[1], y[0])
        line = [x] * (x[0] < x[1]) + mid + [y] * (y[0] < y[1])
        ends = [(0, 1), (len(line) - 2, len(line) - 1)] if len(line) > 1 else []
        return mid if all(self.fit(line[p], line[q]) for p, q in ends) else None

    def matrix(self) -> np.ndarray:
        if len(self.enter) == len(self.leave) == 1 and self.enter[0] == (self.a, self.a) and self.leave[0] == (self.b, self.b):
            return np.zeros((1, 1))
        return np.array([[NEVER if self.inner(i, j) is None else 0.0 for j in range(len(self.leave))] for i in range(len(self.enter))])

    def ids(self, i: int, j: int) -> list[int]:
        """Pieces from after entry state i up to exit state j, itself included."""
        v, x, y = self.v, self.enter[i], self.leave[j]
        stop = v.raw.encode(self.s[slice(*y)]) if y[0] < y[1] else []
        return v.raw.encode(self.s[x[1] : y[0]]) + stop if y[0] > x[1] else stop


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut, the outer ones included, that a path of weight 0 through all matrices takes."""
    before, after = [np.zeros((1, 1))], [np.zeros((1, 1))]
    for m in matrices:
        before.append(times(before[-1], m))
    for m in reversed(matrices):
        after.append(times(m, after[-1]))
    found = [np.flatnonzero(p[0] + q[:, 0] == 0) for p, q in zip(before, reversed(after), strict=True)]
    assert all(len(f) == 1 for f in found), "a text has one encoding"
    return [int(f[0]) for f in found]


def _encode(model: bytes) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = sp.encode(texts, num_threads=1)
                same = [d == t.replace("▁", " ") for d, t in zip(sp.decode(ids, num_threads=1) if ids else [], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "token_ids", "round_trip"])

    return encode


CUT = "row bigint, doc_id bigint, k int, s string, a int, b int"


def _cut(model: bytes) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(model)
        side = 2 * v.longest
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                s = normal(text)
                at = cuts(s, v)
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    low = max(0, a - side)
                    part = s[low : b + side]
                    # of outer cuts nothing shows, so they have one state
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc, pa.int64()), (k, pa.int32()), (part, pa.string()), (a - low, pa.int32()), (b - low, pa.int32()))], ["row", "doc_id", "k", "s", "a", "b"])

    return cut


def _matrices(model: bytes) -> Callable:
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(model)
        for batch in batches:
            got = [Chunk(v, s, a, b).matrix() for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("s", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([m.shape[1] for m in got], pa.int32()), pa.array([m.ravel().tolist() for m in got], pa.list_(pa.float64()))], ["row", "k", "width", "matrix"])

    return matrices


def _states(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    path = scan([np.array(r["matrix"]).reshape(-1, r["width"]) for r in rows])
    return pa.table({"row": [r["row"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "enter": pa.array(path[:-1], pa.int32()), "leave": pa.array(path[1:], pa.int32())})


def _trace(model: bytes) -> Callable:
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(model)
        for batch in batches:
            ids, same = [], []
            for r in batch.select(["s", "a", "b", "enter", "leave"]).to_pylist():
                c = Chunk(v, r["s"], r["a"], r["b"])
                ids.append(c.ids(r["enter"], r["leave"]))
                whole = r["s"][c.enter[r["enter"]][1] : c.leave[r["leave"]][1]]
                same.append(b"".join(v.bytes[i] for i in ids[-1]) == whole.replace("▁", " ").encode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "k")), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["row", "doc_id", "k", "ids", "same"])

    return trace


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, token_ids, round_trip): a row for each row of docs, the ids as the model's own library gives them.

    round_trip: decoding gives the text again, where the model's sign for a space, U+2581, counts as one. Null
    and empty texts have no ids; repeated rows are encoded each; other columns are ignored.
    """
    with open(model, "rb") as f:
        proto = f.read()
    docs = columns_or_null(docs, doc_id="bigint", text="string")
    long = F.coalesce(F.length("text"), F.lit(0)) > CHUNK
    short = docs.where(~long).mapInArrow(_encode(proto), "doc_id bigint, token_ids array<int>, round_trip boolean")
    giant = docs.where(long).withColumn("row", F.monotonically_increasing_id())
    chunks = Table(giant.mapInArrow(_cut(proto), CUT), "chunks").df
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, "row", "k")
    matrices = dealt.mapInArrow(_matrices(proto), "row bigint, k int, width int, matrix array<double>")
    states = matrices.groupBy("row").applyInArrow(_states, "row bigint, k int, enter int, leave int")
    traced = chunks.join(states, ["row", "k"]).mapInArrow(_trace(proto), "row bigint, doc_id bigint, k int, ids array<int>, same boolean")
    parts = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("same").alias("round_trip"))
    return short.unionByName(parts.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"), "round_trip"))


def _decode(model: bytes) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            most = sp.get_piece_size()
            texts = [sp.decode([i for i in ids if i is not None and 0 <= i < most]) if ids else "" for ids in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids), a row for each; null lists give empty texts, null ids and those outside the model nothing."""
    with open(model, "rb") as f:
        proto = f.read()
    return columns_or_null(tokens, doc_id="bigint", token_ids="array<int>").mapInArrow(_decode(proto), "doc_id bigint, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), round_trip, token_ids for every document."""
    got = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip", "token_ids")


common.ship(__name__)
