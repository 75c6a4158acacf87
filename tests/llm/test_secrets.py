"""The secret scan against Python's regular expressions."""

import hashlib
import re

from keyloom.llm import secrets

WORDS = r"""(password|passwd|secret|token|api_?key)"""


def plain(text):
    out = []
    for rank, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


def compare(spark, rows, schema="doc_id long, text string, kinds string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = sorted((r.doc_id, r.text, [tuple(s) for s in r.found]) for r in secrets.scan(df).collect() if r.doc_id is not None)
    assert got == sorted((i, t or "", plain(t)) for i, t in rows if i is not None)


def test_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ALWAYS
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    q = secrets.trigram_query(secrets.RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in q and len(q) == 6
    assert secrets.trigram_query("abc(de|fgh)+x?") == {frozenset({"abc"})}
    assert secrets.trigram_query("(abc|z)+q") == secrets.ALWAYS


def test_odd_rows(spark):
    h = "0123456789abcdef" * 2
    texts = [None, "", "é🙂token = \"abcdef\" x", "token=ab;secret: 'longer-one'", "passwd='token': abcdef1", "PASSWORD=abcdefg api_key:xxxxxxx APIKEY=yyyyyy",
             "AKIA" + "Z" * 16 + " AKIAZZ AKIAAKIA" + "9" * 20, f"{h} x{h}{h} {h[:23]}", "toKen=abcdefgh paſſword=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----",
             "ghp_" + "a" * 36, "xoxb-1234567890-ab", "secret secret = secret = secret=abcdef", "token:\nabcdefg", "🙂" * 50 + f"token={h}", "token=abcdef " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "again token=123456"), (2, texts[2]), (None, "token=abcdef")]
    compare(spark, rows)


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op10_secret_scan(spark, sf).collect():
        want = plain(docs[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for a, n, k, b in want if n < 3)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == n for x in want) for n in range(3))


def test_many_matches_in_one_text(spark):
    compare(spark, [(1, "token=abcdef " * 5000), (2, "api_key=é token=ab " * 300 + "passwd: 123456" * 257), (3, "secret=abcdef " * 256), (4, "secret=abcdef " * 257)])
