"""From documents to token ids: five stages, each of which works on what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it
is written as Parquet and read again. All stages but the last return the
columns of docs. Stages set the session's Arrow batches to few rows, where it
has Spark's own number, so that all models and texts fit small executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import batches, bench_leaks, language, passages, pieces, similar
from weftline.operators import ordering
from weftline.session import held, table

#: A document whose likeliest language has a smaller share of the likelihood is rejected.
LEAST_SCORE = 0.3


def quoted(docs: DataFrame) -> list:
    """All columns of docs, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows. It is fitted on the labelled ones that are not held out; without any, all stay.

    Null and empty texts, and those without a letter, have no language and go.
    Each row is judged by its own text, so rows that repeat stay or go alike.
    """
    batches.few_rows(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs
    lang, score = batches.fresh(docs, "lang_found", "lang_score")
    return language.annotate(docs, model, lang_as=lang, score_as=score).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id.

    A document is an id and a text: of rows that repeat both one stays (the
    smallest by its other columns), while rows that repeat an id with other
    texts are documents of their own, in the order of their texts' hashes.
    Documents without an id, or without words, stay.
    """
    batches.few_rows(spark)
    own = quoted(docs)
    ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        lost = similar.group(docs).where("component_id < doc_id").select(F.col("doc_id").alias("lost_id"))
        return docs.join(lost, F.col("doc_id") == F.col("lost_id"), "left_anti").select(*own)
    # ids repeat: documents are numbered in order, and the numbers joined
    low, high = batches.text_keys("text")
    named = docs.where("doc_id is not null").select("doc_id", low, high, "text").groupBy("doc_id", "text_low", "text_high").agg(F.first("text").alias("text"))
    numbered = held(ordering.numbered(named, ["doc_id", "text_low", "text_high"], "place"), "numbered")
    gone = similar.group(numbered, id_col="place").where("component_id < place").select(F.col("place").alias("lost"))
    lost = numbered.join(gone, F.col("place") == F.col("lost")).select(F.col("doc_id").alias("lost_id"), F.col("text_low").alias("lost_low"), F.col("text_high").alias("lost_high"))
    kept = docs.where("doc_id is not null").join(lost, (F.col("doc_id") == F.col("lost_id")) & (low == F.col("lost_low")) & (high == F.col("lost_high")), "left_anti")
    once = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    return once.unionByName(docs.where("doc_id is null")).select(*own)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id holds too; documents of which nothing is left go. Null and empty texts, and rows without an id, stay as they are; repeated rows are cut alike."""
    batches.few_rows(spark)
    out = passages.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*quoted(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Each row is judged by its own text; null and empty texts hold none and stay."""
    batches.few_rows(spark)
    return bench_leaks.clean(docs, table(spark, sf_dir, "benchmark")).select(*quoted(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends, decoded) of every row, repeated ones too; a null text counts as empty and has no ids."""
    batches.few_rows(spark)
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", "decoded")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_similar),
    ("substring dedup", drop_passages),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express a fitted model, content-defined cuts or piece merging; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = held(docs, "stage")
    return docs
