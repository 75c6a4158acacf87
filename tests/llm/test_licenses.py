"""The licence scan against plain string work."""

import math
import random
import re

from keyloom.llm import licenses


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, t.label, t.base) for t in licenses.TEMPLATES for i in range(len(words)) if words[i : i + len(t.key_words)] == t.key_words)
    return len(words), places


def same(rows, got):
    assert sorted((i, *plain(t)) for i, t in rows) == sorted((r.doc_id, r.n_words, [tuple(p) for p in r.places]) for r in got)


def plain_scores(rows, templates):
    """Each row's places and score, from the words of all rows."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    idf = lambda w: 1 + math.log((len(rows) + 1) / (sum(w in words for words in split) + 1))
    weight = {w: idf(w) for t in templates for w in t.words}
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        places, best = [], 0.0
        for t in templates:
            for k in range(len(words)):
                if words[k : k + len(t.key_words)] == t.key_words:
                    places.append((k, t.label, t.base))
                    there = [weight[w] for j, w in enumerate(t.words) if 0 <= k + j - t.at < len(words) and words[k + j - t.at] == w]
                    best = max(best, sum(there) / sum(weight[w] for w in t.words))
        out.append((i, sorted(places), best))
    return sorted(out)


def test_odd_rows(spark):
    texts = [None, "", "MIT License; mit-license MITé License", "cc by CC-BY 4.0 cc cc by by", "the GNU General Public License, version 3. gnu general public licens",
             "apache\x00license apache_license apacheLicense Kapache license", "All rights reserved. " * 500, "...", "İ mit license", "license mit license mit", "x " * 20000 + "cc by", "released under the MIT License"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (2, "bsd license")]
    got = licenses.scan(spark.createDataFrame([(*r, 5, "a") for r in rows], "doc_id long, text string, n_words int, words string")).collect()
    same(rows, got)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.places)
    assert max(r.score for r in got if r.doc_id == 11) == 1.0


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    for i, t in docs:
        n, places = plain(t)
        base = [p for p in places if p[2]]
        want[i] = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({p[1] for p in base})), ",".join(sorted({p[1] for p in places})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.op6_license_scan(spark, sf).collect()}
    assert got == want


def test_scores(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    notices = [t.notice for t in licenses.TEMPLATES]
    rows += [(-i, f"{n} {n.split()[-1]} some words {' '.join(n.split()[2:])} and {n.upper()}") for i, n in enumerate(notices, 1)]
    got = sorted((r.doc_id, [tuple(p) for p in r.places], r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = plain_scores(rows, licenses.TEMPLATES)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert sum(g[2] > 0 for g in got) >= len(notices)


def test_hundreds_of_templates(spark):
    """Also key phrases with a word twice, phrases inside others, and words that many templates share."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    templates = []
    for k in range(200):
        key = some(rng.randrange(1, 5))
        notice = [*some(rng.randrange(3)), *key, *some(rng.randrange(3))]
        at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        templates.append(licenses.Template(f"l{k}", " ".join(notice), " ".join(notice[at : at + len(key)]), k % 2 == 0))
    templates.append(licenses.Template("twice", "so w1 w2 w1 it is", "w1 w2 w1"))
    rows = [(i, " ".join(some(rng.randrange(60)))) for i in range(60)] + [(60, "w1 w2 w1 w2 w1 so w1 w2 w1 it is")]
    got = sorted((r.doc_id, [tuple(p) for p in r.places], r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), tuple(templates)).collect())
    want = plain_scores(rows, templates)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
