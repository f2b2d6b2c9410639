"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents; the last returns the encoded corpus.

The pipeline is an application, which sets its session up: stages that run Python bound the Arrow batches of the jobs that follow, as several models and
their buffers share an executor's memory.  The operators themselves leave the session's settings as they are.

Cases, for every stage: null and empty texts are not toxic, are no copies of each other, hold no personal data and are encoded to no tokens; very long texts are
read whole; repeated rows are judged each, and all but one go as copies; null labels are a value of their own; extra columns, whatever their names, pass through
all stages but the last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlark.llm import bpe, minhash, pii, raking, toxicity
from boardlark.llm.queries import tokenizer_path
from boardlark.llm.shared import BATCH, Scratch, fresh, held_out, read


def configure(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; labels are learned as in the operator's own query."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), usable=~held_out(F.col("doc_id")))
    score, evidence = fresh(docs.columns, "score"), fresh(docs.columns, "evidence")
    configure(spark)
    return toxicity.classify(docs, model, score=score, evidence=evidence).where(F.col(score) < toxicity.TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest id.  Rows are judged each by its own text:
    of repeated rows one stays, equal ids with different texts both stay, and null ids are compared like others."""
    return minhash.one_of_each(docs, words=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts is replaced by its kind, and n_chars follows."""
    out = pii.redact(docs)
    configure(spark)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that bring sources, languages and topics to their target weights."""
    return raking.sample(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and the digest of the text that they decode to."""
    out = bpe.round_trip(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])
    configure(spark)
    return out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", redact), ("mixing", mix), ("encoding", encode)]

#: SQL can express neither the nearest-example scores nor the tokenizer; tests/llm compares stages and run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
