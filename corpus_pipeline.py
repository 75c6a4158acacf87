"""From raw documents to token ids: five stages, each one of the training-data operators.

A stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns the columns of
documents (the last one: doc_id, n_tokens, token_ids). run() writes each stage's rows to the shared folder and reads
them again, so that a stage never recomputes another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, pieces, pii, quality, simhash
from keyloom.llm.common import plainly, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores a half or more; it learns from the labels of these documents."""
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    scored = quality.score(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("quality_score >= 0.5").select(*plain.columns).toDF(*docs.columns)


def keyed(docs: DataFrame, id_of: Column, hash_of: Column) -> DataFrame:
    """docs under plain column names, and what tells rows apart: the id (0 if null), and a hash of the text and of whether there is an id."""
    return docs.withColumns({"doc_key": F.coalesce(id_of, F.lit(0)), "text_key": F.when(id_of.isNull(), F.xxhash64(hash_of)).otherwise(hash_of)})


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose 5-word shingles are 0.8 alike or more one stays: that with the smallest id, of several rows under it one text.

    A document without an id stays if no copy has one; of rows alike in id and text one stays. Different texts under one id are different documents.
    """
    found = simhash.similar_documents(docs).where("kept").select("doc_id", "text_hash")
    low = keyed(found, F.col("doc_id"), F.col("text_hash")).select("doc_key", "text_key").distinct()
    plain = plainly(docs)
    doc_id, text = (F.col(plain.columns[docs.columns.index(c)]) for c in ("doc_id", "text"))
    single = keyed(plain, doc_id.cast("bigint"), F.xxhash64(text)).dropDuplicates(["doc_key", "text_key"])
    return single.join(low, ["doc_key", "text_key"], "left_semi").select(*plain.columns).toDF(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select(F.col("doc_id").alias("bad_id")).distinct()
    plain = plainly(docs)
    doc_id = F.col(plain.columns[docs.columns.index("doc_id")])
    return plain.join(bad, doc_id.eqNullSafe(F.col("bad_id")), "left_anti").toDF(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.encode(docs).select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", hide_personal_data),
    ("SentencePiece encoding", tokenize),
]

#: SQL has no trained classifier, XXH64 fingerprints or BPE: tests/llm/test_pipeline.py checks each stage by plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
