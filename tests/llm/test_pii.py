"""Personal data: exact kinds against plain expressions, and the bootstrap on a planted context."""

import hashlib
import random
import re

from keyloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["a@b.co", "@", "x.y+z@d-e.f.g", "@@", "a@b@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", " ", "-", "+1 (603) 555-8791", "+12345678901234567", "+", "é🙂", "٣", ".", "7831179344661714"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_linear_on_long_runs():
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("9" * 300_000) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op1_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (r.spans + ",").startswith(line)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"noise {i} my address is 10.0.0.{i} since monday") for i in range(10)]
    rows += [(50, "well my address is 10.0.0.999 since monday"), (51, "order 12345678 arrived"), (52, None), (52, ""), (None, "x"), (50, "well my address is 10.0.0.999 since monday")]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, spans string")
    got = {}
    for r in pii.extract(df).collect():
        got.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert got[50] == [[("ip_ctx", 19, 29)]] * 2 and got[51] == [[]] and got[52] == [[], []] and got[None] == [[]]
    assert got[3] == [[("ip", 22, 30)]]


def found(spark, texts):
    rows = pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind.endswith("_ctx")] for r in rows if any(s.kind.endswith("_ctx") for s in r.spans)}


def test_other_shapes_are_found(spark):
    """Of each kind, contexts of thirty seeds find what no rule does, whatever its shape, behind any white space and words of any length."""
    long = "x" * 300
    texts = [f"please call me at +1 (603) 555-87{k:02d} today my friend" for k in range(30)]
    texts += [f"write to user{k}@mail.com" for k in range(30)]
    texts += [f"{long} paid by card 4111 1111 1111 {k} as agreed" for k in ("1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194")]
    n = len(texts)
    texts += ["call me at 603.555.8791 today my friend", "he will write to john(at)mail.com", "do write \n\n" + " " * 500 + " to @john_smith.", f"and {long} paid by card 4111-1111 of 2020 as agreed", "call me at noon today my friend", "write to 12 people"]
    texts += ["the number 603.555.8791 stands alone here", "call me at (603) 555 8791 today my friend"]
    got = found(spark, texts)
    assert got[n] == [("phone_ctx", "603.555.8791")] and got[n + 1] == [("email_ctx", "john(at)mail.com")] and got[n + 2] == [("email_ctx", "@john_smith")]
    assert got[n + 7] == [("phone_ctx", "(603) 555 8791")] and not set(got) & {*range(n), n + 4, n + 6}


def test_doubtful_patterns_find_nothing(spark):
    texts = [f"reach us at 10.0.{k}.{k} or so" for k in range(10)] + [f"reach us at {k}:30 or so" for k in range(10)]
    assert found(spark, texts) == {}


def plain_bootstrap(seen):
    """The scored graph with dictionaries."""
    pairs = {(p, i) for i, _, _, ps in seen for p in ps}
    around = {}
    for p, i in pairs:
        around.setdefault(p, set()).add(i)
    seeds = {}
    for i, kind, _, _ in seen:
        if kind:
            seeds[i] = min(kind, seeds.get(i, kind))
    shape = {}
    for i, _, s, _ in seen:
        shape[i] = min(s, shape.get(i, s))
    known = {i: (k, 1.0) for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        sure = {}
        for p, members in around.items():
            for kind in pii.KINDS:
                trust = [known[i][1] for i in members if i in known and known[i][0] == kind]
                if sum(t >= pii.LEAST_INSTANCE for t in trust) >= pii.LEAST_SUPPORT and sum(trust) / len(members) >= pii.LEAST_PATTERN:
                    sure[p, kind] = sum(trust) / len(members)
        best = {}
        for i in shape:
            for kind in pii.KINDS:
                left = 1.0
                for (p, k), v in sure.items():
                    if k == kind and i in around[p]:
                        left *= 1 - min(v, 0.99)
                if left < 1 and i not in seeds:
                    like = [known[j][1] for j in shape if shape[j] == shape[i] and j in known and known[j][0] == kind]
                    trust = 1 - left * (1 - pii.SHAPE_WEIGHT * min(1.0, sum(like) / sum(s == shape[i] for s in shape.values())))
                    best[i] = max(best.get(i, (0.0, "")), (trust, kind))
        known = {i: (k, 1.0) for i, k in seeds.items()} | {i: (k, t) for i, (t, k) in best.items()}
    return {(i, p, k) for i, (k, t) in known.items() if t >= pii.LEAST_INSTANCE and i not in seeds for p, kind in sure if kind == k and i in around[p]}


def test_graph_against_dictionaries(spark):
    rng = random.Random(6)
    seen = []
    for i in range(160):
        kind = rng.choice(pii.KINDS) if i < 145 else None
        group = pii.KINDS.index(kind) if kind else rng.randrange(4)
        ps = rng.sample(range(6 * group, 6 * group + 6), rng.randint(0, 3)) if rng.random() < 0.95 else [rng.randrange(24)]
        seen.append((i, kind, rng.randrange(5), ps))
    flat = [(i, k, s, p) for i, k, s, ps in seen for p in ps or [None]]
    want = plain_bootstrap(seen)
    pii_rows = pii.bootstrap(spark.createDataFrame(flat, "instance long, kind string, shape long, pattern long")).collect()
    assert {(r.instance, r.pattern, r.kind) for r in pii_rows} == want and want


def test_redact_keeps_rows(spark):
    rows = [(1, "mail a@b.co now", 7), (1, "mail a@b.co now", 7), (2, None, 1), (None, "1.2.3.4", 2)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, seen int"))
    assert out.columns == ["doc_id", "text", "seen"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "mail [EMAIL] now", 7)] * 2 + [(2, None, 1), (None, "[IP]", 2)]))


def test_empty(spark):
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0
