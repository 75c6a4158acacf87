"""The pipeline's stages on a small table, each against what its operator finds."""

import sentencepiece
from pyspark.sql import functions as F
from test_decontam import plain as leaks
from test_pii import plain as spans
from test_simhash import plain_similar

import corpus_pipeline
from keyloom.llm import pieces, quality

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    order = list(stage)
    assert order == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding"]

    good = stage[order[0]](spark, docs, SF).cache()
    scored = {r.doc_id: r.quality_score for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == docs.columns and set(rows(good)) == {i for i, s in scored.items() if s >= 0.5}
    right = [(i in rows(good)) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    single = stage[order[1]](spark, good, SF).cache()
    assert single.columns == docs.columns and set(rows(single)) == set(plain_similar([(i, r.text) for i, r in rows(good).items()]).values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pure = stage[order[2]](spark, single, SF).cache()
    bad = {d for d, _ in leaks([(i, r.text) for i, r in rows(single).items()], items)}
    assert pure.columns == docs.columns and set(rows(pure)) == set(rows(single)) - bad

    hidden = stage[order[3]](spark, pure, SF).cache()
    before, after = rows(pure), rows(hidden)
    assert hidden.columns == docs.columns and set(before) == set(after)
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not spans(r.text)
        assert (r.text == before[i].text) >= (not spans(before[i].text) and "[" not in r.text)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = rows(stage[order[4]](spark, hidden, SF))
    assert {i: r.token_ids for i, r in out.items()} == {i: library.encode(r.text) for i, r in after.items()}
    assert all(r.n_tokens == len(r.token_ids) for r in out.values())
    assert {i: r.token_ids for i, r in rows(corpus_pipeline.run(spark, SF)).items()} == {i: r.token_ids for i, r in out.items()}


def test_repeated_and_null_rows(spark):
    rows = [(1, "good words stand here today", None, "s", 3), (1, "good words stand here today", None, "s", 3), (None, "x", "en", None, None), (None, "x", "en", None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    rows += [(1, "an entirely different text under an id that is taken", "de", "s", 9), (4, "An entirely different text under an id that is taken", "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert sorted(str((r.doc_id, (r.text or "")[:4])) for r in kept.collect()) == ["(1, 'an e')", "(1, 'good')", "(2, '')", "(None, 'x')"]
    assert corpus_pipeline.drop_leaks(spark, docs, SF).count() == 8
    assert corpus_pipeline.hide_personal_data(spark, docs, SF).count() == 8
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == 8
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0


CLASHING = ["kept_id", "bad_id", "pii_spans", "pii_id", "pii_hash", "doc_key", "text_key", "c0", "c1", "score", "quality_score", "node", "text_hash", "row", "id", "spans", "found", "held_out", "component_id", "kept"]


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    wide = docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    for name, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, wide, SF)
        assert got.columns == wide.columns, name
        assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r) for r in f(spark, docs, SF).collect()), name
    assert corpus_pipeline.tokenize(spark, wide, SF).count() == 40
