"""The n-gram model against a plain reckoning with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from keyloom.llm import ngram

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_steps(train):
    """A function of a text: p of each of its tokens, the end the last, by dictionaries."""
    train = [["<", *tokens(t), None] for t in train]
    one = Counter(w for t in train for w in t[1:])
    two = Counter(p for t in train for p in zip(t, t[1:]))
    three = Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    before1 = Counter(w for _, w in two)
    before2 = Counter((v, w) for _, v, w in three)
    before2.update({(v, w): c for (v, w), c in two.items() if v == "<"})
    levels = []
    for counts in (before1, before2, three):
        follow, led = defaultdict(lambda: [0, 0, 0]), Counter()
        for gram, c in counts.items():
            context = gram[:-1] if isinstance(gram, tuple) else ()
            follow[context][min(c, 3) - 1] += 1
            led[context] += c
        d = ngram.discounts(np.array([sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]))
        levels.append((counts, follow, led, d))

    def steps(text):
        t, out = ["<", *tokens(text), None], []
        for i in range(1, len(t)):
            p = 1 / (len(one) + 1)
            for n, (counts, follow, led, d) in enumerate(levels):
                context = tuple(t[i - n : i])
                if i < n or not led[context]:
                    break
                c = counts[(*context, t[i]) if n else t[i]]
                p = (max(c - (0, *d)[min(c, 3)], 0) + sum(a * b for a, b in zip(d, follow[context])) * p) / led[context]
            out.append(p)
        return out

    return steps


def plain(rows):
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, steps = Counter(w for t in train for w in [*tokens(t), None]), plain_steps(train)
    n, v, out = sum(one.values()), len(one), {}
    for i, t in rows:
        all_of = [*tokens(t), None]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in all_of)
        out[i] = (len(all_of), sum(w in one for w in all_of), n, base, sum(map(math.log10, steps(t))))
    return out


def same(spark, rows, docs):
    docs = docs.selectExpr("*", "crc32(cast(doc_id as string)) % 7 = 2 as held_out")
    got = {r.doc_id: r for r in ngram.scores(docs, ngram.train(docs.where("not held_out"))).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    same(spark, [tuple(r) for r in docs.collect()], docs)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \x0b A a\tÀ a b "), (4, "a b " * 3000), (5, "a b"), (6, "zz"), (7, "x"), (8, "\x85 q")]
    same(spark, rows, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    m = ngram.train(docs)
    assert ngram.scores(docs, m).count() == 0
    row = ngram.scores(spark.createDataFrame([(1, "a", False)], "doc_id long, text string, held_out boolean"), m).first()
    assert row.train_tokens == 0 and row.score == 0.0


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(["a b a", "b c", "a c c"])], "doc_id long, text string, held_out boolean")
    m = ngram.train(docs)
    assert m.vocabulary == 4
    known, probe = ["a", "b", "c"], ["a", "b", "c", "a zz", "a b", "a c", "b c", "zz a", "c c"]
    texts = [*(f"{h} {w}" for h in probe for w in [*known, "new"]), *probe, *(w for w in [*known, "new"])]
    rows = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], docs.schema)
    score = {texts[r.doc_id]: r.score for r in ngram.scores(rows, m).collect()}
    # the model's scores are those of the plain steps, and the plain steps sum to one
    steps = plain_steps(["a b a", "b c", "a c c"])
    for t in texts:
        assert math.isclose(score[t], sum(math.log10(p) for p in steps(t)), rel_tol=1e-9)
    for h in ["", *probe]:  # each known word, one unknown word, the end
        after = [steps(f"{h} {w}".strip())[len(h.split())] for w in [*known, "new"]] + [steps(h)[-1]]
        assert math.isclose(sum(after), 1.0, rel_tol=1e-9), h


def test_hot_and_often(spark):
    """Words with a large share of all tokens, n-grams of 255 and more, many parts."""
    rows = [(i, " ".join(["the", f"w{i % 7}", "the"] * (i % 9 + 1) + [f"x{i}", "the end"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(spark, rows, docs)


def test_within():
    a = np.array([1, 4, 9, 2, 3, 8, 8])
    low, high, x = np.array([0, 0, 3, 3, 5, 2]), np.array([3, 3, 5, 7, 5, 3]), np.array([4, 10, 1, 8, 7, 9])
    assert ngram.within(a, low, high, x).tolist() == [1, 3, 3, 5, 5, 2]
