"""SentencePiece: ids against the model's own library, the scan on hard boundaries, round trips."""

import base64
import random

import numpy as np
import pytest
import sentencepiece

from keyloom.llm import pieces as P

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.MODEL, "rb") as f:
        return P.Pieces(f.read())


def hard():
    rng = random.Random(1)
    pick = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    return [
        "a" * 2000, " " * 1500, "aé🙂\n" * 400, "the quick brown fox " * 100, base64.b64encode(rng.randbytes(1500)).decode(), pick("abcdefghij", 2000),
        "".join(chr(rng.randint(0x4E00, 0x5000)) for _ in range(1500)), pick(["in", "ing", "tion", "er", "  ", "    ", " ", "the", "▁", "\t", "="], 900),
        "=" * 1500, "ab" * 900, pick(" a", 1500), "-" * 999 + " " * 333, "x" * 300, "x" * 301, " " + "y" * 299,
    ]


@pytest.mark.parametrize("search", [0, 64])
def test_scan_gives_the_library_s_ids(vocabulary, monkeypatch, search):
    monkeypatch.setattr(P, "CHUNK", 300)
    monkeypatch.setattr(P, "SEARCH", search)
    for text in hard():
        s = P.normal(text)
        at = P.cuts(s, vocabulary)
        chunks = [P.Chunk(vocabulary, s[max(0, a - 32) : b + 32], min(a, 32), b - max(0, a - 32)) for a, b in zip(at, at[1:], strict=False)]
        path = P.scan([c.matrix() for c in chunks])
        assert [i for c, e, x in zip(chunks, path, path[1:], strict=False) for i in c.ids(e, x)] == LIBRARY.encode(text)


def test_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.5, rng.integers(-5, 5, s).astype(float), P.NEVER) for s in ((3, 4), (4, 2), (2, 5)))
    assert np.array_equal(P.times(P.times(a, b), c), P.times(a, P.times(b, c)))


def test_whole_table_and_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = P.encode(docs)
    assert {r.doc_id: (r.token_ids, r.round_trip) for r in got.collect()} == {i: (LIBRARY.encode(t), True) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in P.decode(got).collect()} == texts


def test_odd_rows(spark):
    texts = [None, "", " ", "▁", "<0x41></s>\x00", "giant words and so on " * 4000, "q" * 100_000, " " * 40_000, "🙂" * 33_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "x")]
    got = P.encode(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, token_ids string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.token_ids, r.round_trip) for r in got), key=key) == sorted(((i, LIBRARY.encode(t or ""), True) for i, t in rows), key=key)


def test_empty(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert P.decode(spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")).first().text == ""


def test_ids_outside_the_model(spark):
    got = P.decode(spark.createDataFrame([(1, [-1, 10**6, None]), (2, None)], "doc_id long, token_ids array<int>")).collect()
    assert {r.doc_id: r.text for r in got} == {1: "", 2: ""}
