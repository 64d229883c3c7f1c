"""Queries of the training-data operators: one thin query each, over its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import audit, batches, bench_leaks, language, licenses, neighbours, oracles, passages, pieces, quality, similar, token_counts, token_store, url_filter, vector_codes
from weftline.session import table

QUERIES: dict = {}
ORACLES: dict = dict(oracles.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.element_at("ends", F.when(F.size("ends") > 0, -1)), F.lit(0)).alias("covered_bytes"),
    )


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out))
    return language.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_leaks.regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where("vec_id % 100 = 0"))


@query
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches.few_rows(spark)
    store = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), token_store.new_store(spark))
    return token_store.summary(spark, store)


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.group(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
