"""The queries of this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm.common import documents
from tidings.llm.oracles import ORACLES  # noqa: F401


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidings.llm.bpe import encode

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.linededup import dedup_lines, digests

    return digests(dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.toxicity import score, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.decontam import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.secrets import digests, find_secrets

    return digests(find_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.ann import nearest_neighbours

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.substring import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.pii import digests, find_pii, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(find_pii(docs, train(docs)))


#: A conversation whose texts look like control strings.
HARD_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.chat import conversations_as_trees, digests, format_reply_trees
    from tidings.operators.storage import materialize

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CONVERSATION, "conv_id long, turn long, role string, text string")
    messages = materialize(conversations_as_trees(rows.union(hard)), "messages")
    return digests(materialize(format_reply_trees(messages), "formatted"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidings.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.audit import filter_interactions

    return filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidings.llm.clusters import cluster_vectors

    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, size=64, seed=2)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_ann": op2_ann,
    "op3_substring": op3_substring,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_lines": op6_lines,
    "op7_decontam": op7_decontam,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_packing": op11_packing,
    "op12_filters": op12_filters,
    "op13_clusters": op13_clusters,
}
