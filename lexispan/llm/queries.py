"""Registered queries of the corpus operators, on whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm import bpe_codec, embedding_dedup, exact_dedup, lexical_search, license_scan, lm_scoring, minhash_dedup, packing, sentencepiece_codec, sharding, spelling, substring_dedup, toxicity
from lexispan.llm.common import documents
from lexispan.llm.oracles import ORACLES


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scoring.score_documents(documents(spark, sf_dir))
    return scores.withColumns({"logscore": F.round("logscore", 4), "mean_logscore": F.round("mean_logscore", 7)})


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = sentencepiece_codec.MODEL_PATH) -> DataFrame:
    with open(model_path, "rb") as f:  # the driver's own file; the model travels with the tasks
        model = sentencepiece_codec.load_model(f.read())
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir), model)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tagged = toxicity.tag_toxicity(docs, model)
    return tagged.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic_tokens", "spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(documents(spark, sf_dir), keep_text=False).drop("spans", "factors")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_bpe_codec(spark: SparkSession, sf_dir: str, model_path: str = bpe_codec.MODEL_PATH) -> DataFrame:
    with open(model_path, "rb") as f:  # the driver's own file; the model travels with the tasks
        model = bpe_codec.load_model(f.read())
    coded = bpe_codec.decode_documents(bpe_codec.encode_documents(documents(spark, sf_dir), model), model)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_lm_scoring,
        op3_embedding_dedup,
        op4_sentencepiece,
        op5_exact_dedup,
        op6_minhash_dedup,
        op7_toxicity,
        op8_sharding,
        op9_substring_dedup,
        op10_best_fit_packing,
        op11_bpe_codec,
        op12_spelling_variants,
        op13_lexical_search,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
