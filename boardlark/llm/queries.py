"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlark.llm import bpe, divergence, hash_tree, jpeg, langid, minhash, oracles, pii, raking, token_rollup, toxicity
from boardlark.llm.shared import Scratch, held_out, read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(read(spark, sf_dir, "documents"), keep=["doc_id"]))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the whole table: a quick estimate at loading, the exact counts as revisions, word counts under a second version, and the
    removal of exact copies: all rows are deleted and of each text the row of the smallest id (a null id last) is inserted again, in one batch.  The second is
    committed twice, to no effect."""
    scratch = Scratch(spark, "rollup")
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(
        "doc_id", "text", "source", "lang",
        F.ceil(F.octet_length(text) / 4).alias("estimate"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words"),
        F.sha2(text.cast("binary"), 256).alias("name"),
    )
    return token_rollup_of(docs, scratch)


def token_rollup_of(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """op2's batches over rows of doc_id, text, source, lang, estimate, words and name (of the text)."""
    spark = docs.sparkSession
    counted = scratch.table(token_rollup.rank_tokens(docs, tokenizer_path("byte_bpe_50k.tiktoken"), keep=["doc_id", "source", "lang", "estimate", "words", "name"]), "counted")
    stays = counted.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", "n_tokens", "words")).alias("s")).select("s.*")

    def changes(rows: DataFrame, op: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    def both(rows: DataFrame, op: str) -> DataFrame:
        return changes(rows, op, "byte_bpe_50k", "n_tokens").union(changes(rows, op, "words", "words"))

    store = token_rollup.RollupStore(spark, f"{scratch.root}/store")
    exact = changes(counted, token_rollup.REVISE, "byte_bpe_50k", "n_tokens", "estimate")
    store.commit("0001-load", changes(counted, token_rollup.INSERT, "byte_bpe_50k", "estimate"))
    store.commit("0002-exact", exact)
    store.commit("0003-words", changes(counted, token_rollup.INSERT, "words", "words"))
    store.compact()
    store.commit("0004-copies", both(counted, token_rollup.DELETE).union(both(stays, token_rollup.INSERT)))
    store.commit("0002-exact", exact)
    scratch.only("store")
    return store.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), usable=~held)
    scored = toxicity.classify(docs, model, keep=["doc_id"])
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["example"], e["label"], F.round(e["cosine"], 4))), ",")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"), evidence.alias("evidence"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


#: 24 shards in 3 regions of 2 racks.
TREE = hash_tree.layout(3, 2, 4)


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(read(spark, sf_dir, "documents"), TREE, hash_tree.grow(TREE, 24)).withColumn("law", F.lit("key"))


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(read(spark, sf_dir, "documents"))


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jpeg.store(read(spark, sf_dir, "documents"), keep=["doc_id"], media=None)
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height"), "thumb_hash")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    profiles = langid.collect_profiles(langid.learn(docs, usable=~held))
    return langid.identify(docs, profiles, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"]))


def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raking.mixed(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.round("weight", 3).alias("cell_weight"), F.round("probability", 9).alias("probability"), "selected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_rollup": op2_token_rollup,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_hash_tree": op5_hash_tree,
    "op6_divergence": op6_divergence,
    "op7_jpeg": op7_jpeg,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_raking": op10_raking,
}

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": oracles.near_duplicates(2, minhash.SIMILAR),
    "op5_hash_tree": oracles.sharding(TREE, hash_tree.grow(TREE, 24)),
    "op6_divergence": oracles.quality(),
    "op10_raking": oracles.mixing(),
}
