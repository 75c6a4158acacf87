"""SimHash near duplicates against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from keyloom.llm import simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: list of (name, fingerprint)."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    x = np.array([f for _, f in fps], np.uint64)
    for a in range(len(x)):
        for b in np.flatnonzero(np.bitwise_count(x[a + 1 :] ^ x[a]) <= 4) + a + 1:
            root[find(int(b))] = find(a)
    low = {}
    for k, (name, _) in enumerate(fps):
        low[find(k)] = min(low.get(find(k), name), name)
    return [low[find(k)] for k in range(len(fps))]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(docs, plain_components(docs), strict=True)}
    assert {tuple(r) for r in simhash.op9_simhash(spark, sf).collect()} == want


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \x0b\n"), (7, "One"), (6, "one"), (8, "a b c"), (8, "a b c"), (3, "É é\x85x a"), (2, "w " * 50_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp long, component_id int")).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", c) for (i, f), c in zip(fps, plain_components(fps), strict=True))
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def crowd(n, seed):
    """Fingerprints around a few centres, so that keys are crowded."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 12)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize(("hot", "cut"), [(20_000, 1024), (40, 64), (300, 128)])
def test_crowded_and_cut_keys(spark, monkeypatch, hot, cut):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SLICE", cut)
    fps = crowd(1500, hot)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(df).collect()
    pairs = [(k, f) for k, f in enumerate(fps)]
    want = plain_components(pairs)
    place = {f - (1 << 64) if f >> 63 else f: k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in edges:
        assert want[place[r.a]] == want[place[r.b]]
        a, b = sorted((find(place[r.a]), find(place[r.b])))
        root[b] = a
    assert [find(k) for k in range(len(fps))] == want


def test_similar_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 400)))) for i in range(150)]
    for i in range(60):  # one word in sixty changed: about 0.85 alike
        w = rows[i][1].split()
        for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "two words"), (2003, "two"), (2004, rows[3][1].upper())]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")).collect()}
    assert got == plain_similar(rows) and got[2001] == 2000 and got[2004] == 3
    assert all(got[i] == i for i in range(150)) and sum(got[1000 + i] == i for i in range(60)) >= 50
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_rows(spark):
    rows = [(1, "one text of seven words stands here"), (1, "another text that only shares its id"), (2, "ONE text of seven words stands here"), (None, "another text that only shares its id"), (None, "a text without any id at all"), (1, "one text of seven words stands here")]
    got = simhash.similar_documents(spark.createDataFrame([(*r, True, 3) for r in rows], "doc_id long, text string, kept boolean, text_hash int")).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (1, 1, True), (None, 1, False), (None, None, True)]))


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 300, np.uint64)
    x[150:] = x[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    for radius in (0, 1, 3, 4, 7, 20):
        i, j = simhash.near(x, simhash.planes(x), len(x), list(range(64)), radius)
        want = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


def plain_sets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_similar(docs):
    """The smallest name that each of (name, text) reaches over shingle sets 0.8 alike or more, all pairs compared."""
    sets = [plain_sets(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    names = {}
    for k, (name, _) in enumerate(docs):
        names[find(k)] = min(names.get(find(k), name), name)
    return {name: names[find(k)] for k, (name, _) in enumerate(docs)}


def prose(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def similar(spark, docs):
    return {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_repeated_lines_do_not_outvote_prose(spark):
    rng = random.Random(4)
    line = prose(rng, 14)
    docs = [(i, " ".join(prose(rng, 304) + line * 20)) for i in range(40)]
    for i in range(20):  # and a copy of prose with another line five times: 0.95 alike as sets
        text = prose(rng, 204)
        docs += [(100 + i, " ".join(text)), (200 + i, " ".join(text + prose(rng, 10) * 5))]
    want = plain_similar(docs)
    assert all(want[i] == i for i in range(40)) and all(want[200 + i] == 100 + i for i in range(20))
    assert similar(spark, docs) == want


@pytest.mark.parametrize("hot", [20_000, 5])
def test_every_pair_at_the_threshold(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    line, docs = prose(rng, 12), []
    for i in range(120):  # of n shingles one side lacks just as many as 0.8 allows, or one more; half have the common line
        text = prose(rng, rng.randint(40, 500)) + line * (i % 2)
        n = len(plain_sets(" ".join(text)))
        docs += [(i, " ".join(text)), (1000 + i, " ".join(text[: len(text) - n // 5])), (2000 + i, " ".join(text[n // 5 + 1 :]))]
    docs += [(3000 + i, " ".join(line + prose(rng, 2))) for i in range(40)]
    want = plain_similar(docs)
    assert all(want[1000 + i] == i and want[2000 + i] == 2000 + i for i in range(120))
    assert similar(spark, docs) == want


def test_wide_fingerprints():
    rng = random.Random(1)
    text = " ".join(prose(rng, 60) + prose(rng, 1) * 30)
    h = {xxhash.xxh64_intdigest(" ".join(s), 42) for s in plain_sets(text)}

    def more(x, k):
        x = (x + k * 0x9E3779B97F4A7C15) % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    words = [[more(x, k) if k else x for x in h] for k in range(4)]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w) > len(w)) for w in words]
    assert [f % (1 << 64) for f in simhash.wide_fingerprint(simhash.shingle_set(text))] == want
    assert simhash.wide_fingerprint(simhash.shingle_set("")) == [0] * 4


@pytest.mark.parametrize("cut", [1024, 64])
def test_exact_check_after_fingerprints(cut):
    rng = np.random.default_rng(cut)
    fp = rng.integers(0, 1 << 64, (12, 4), np.uint64)[rng.integers(0, 12, 400)]
    for _ in range(25):
        fp[np.arange(400), rng.integers(0, 4, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    name = rng.integers(0, 6, 400)
    asked = set()

    def same(i, j):
        assert (i, j) not in asked
        asked.add((i, j))
        return name[i] == name[j]

    got = simhash.link_sorted(np.zeros(400, np.int64), fp, lambda k: list(range(256)), 30, cut, same)
    label = np.arange(400)
    label[got[0]] = got[1]
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 30
    want = np.arange(400)
    while True:
        low = np.where(near & (name[:, None] == name[None]), want[None], 400).min(1)
        if (low == want).all():
            break
        want = low
    assert (label == want).all() and len(set(want)) > 12


def test_fingerprints_find_the_pairs(spark, monkeypatch):
    rng = random.Random(6)
    line, docs = prose(rng, 14), []
    for i in range(100):  # copies 0.9 alike, texts half alike, and a common line in all of them
        text = prose(rng, rng.randint(100, 500)) + line * (1 + i % 9)
        n = len(plain_sets(" ".join(text)))
        docs += [(i, " ".join(text)), (1000 + i, " ".join(text[n // 10 :])), (2000 + i, " ".join(text[n // 2 :]))]
    want = plain_similar(docs)
    assert all(want[1000 + i] == i and want[2000 + i] == 2000 + i for i in range(100))
    labels, rest = [], simhash.rest_links

    def seen(nodes, *others):
        labels.append(nodes.groupBy("label").count().where("count > 1").count())
        return rest(nodes, *others)

    monkeypatch.setattr(simhash, "rest_links", seen)
    assert similar(spark, docs) == want
    monkeypatch.setattr(simhash, "rest_links", lambda nodes, *_: spark.createDataFrame([], "a bigint, b bigint"))
    got = similar(spark, docs)
    assert all(got[i] in (want[i], i) for i in got) and labels == [sum(got[1000 + i] == i for i in range(100))] and labels[0] >= 95
