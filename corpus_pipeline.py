"""A pipeline for training text: language ID, exact dedup, near-dedup, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a stage returns as Parquet
into the shared folder and gives it, read again, to the next. All stages but the last return the columns of documents.

Defined results: a document keeps all its columns, whatever further ones it has and whatever they are called. Repeated rows and ties are settled by the
operators (of equal or similar texts the smallest doc_id stays). An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import common, exact_dedup, language, packing, queries, similar, suffixes

#: Bytes of a passage that counts as repeated across documents: fifty words of everyday prose are seldom shorter.
PASSAGE_BYTES = 240
PASSAGE_GRAM = 96


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the predicted one where it was null. Null and empty texts and those without a letter go."""
    common.ship(spark)
    own, names = common.numbered(docs)
    at = {name: own.columns[names.index(name)] for name in ("doc_id", "text", "lang")}
    model = language.fit(own, at["doc_id"], at["text"], at["lang"])
    predicted = language.predict(own, model, at["text"]).where(~F.col("rejected"))
    return predicted.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")).select(*own.columns).toDF(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set with the same text."""
    common.ship(spark)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, a similarity of 0.8 or more."""
    common.ship(spark)
    return similar.keep_one(docs, words=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere; those of which nothing is left go, unless they were empty before. A null text stays null."""
    common.ship(spark)
    own, names = common.numbered(docs)
    ident, text, chars = (own.columns[names.index(name)] for name in ("doc_id", "text", "n_chars"))
    left = suffixes.remove_repeats(own.withColumn("whole", F.col(text)), ident, "whole", length=PASSAGE_BYTES, gram=PASSAGE_GRAM)
    same = F.col("n_removed") == 0
    written = left.withColumn(text, F.when(same, F.col(text)).otherwise(suffixes.whole_characters(F.col("kept")))).where(same | (F.trim(text) != ""))
    return written.withColumn(chars, F.when(same, F.col(chars)).otherwise(F.length(text).cast("long"))).select(*own.columns).toDF(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 1024 tokens."""
    import public_tokenizers

    common.ship(spark)
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, cached=50_000)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near-dedup", near), ("suffix-array dedup", passages), ("best-fit packing", pack)]

#: No stage but the second could be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
