"""From raw documents to packed sequences: toxic text out, unrecognised languages out, one of each group of near copies,
secrets blanked, ids packed. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import language, packing, secrets, similar, simhash, toxicity
from rollbook.llm.queries import END_ID, WORD_TOKENIZER
from rollbook.llm.shared import only, small_batches, stored

ROW = "pipeline_row"
#: Words that a packing worker keeps; less than in a job of its own, as the stages share their workers.
CACHE_WORDS = 50_000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a model of the labelled ones."""
    with small_batches(spark):
        model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return stored(docs.filter(toxicity.toxicity(model, "text") < 0.5), "not-toxic")


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject; `lang` stays as it was."""
    with small_batches(spark):
        model = language.fit_documents(docs)
        return stored(docs.filter(~language.language(model, "text")["rejected"]), "known-languages")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of near copies (five-word shingles, similarity 0.8 or more, exact); rows have numbers
    of their own, so repeated ids do no harm.

    Groups by SimHash come first, but of 64 bits two texts of similarity 0.8 differ in about ten, more than a fingerprint can
    be searched for. So their members become candidates, beside those of a wider search, and all are held to the similarity.
    """
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    with small_batches(spark):
        by_fingerprint = simhash.near_copies(numbered, id_column=ROW, words=5, bits=4)
        candidates = by_fingerprint.select(F.col("component_id").alias("a"), F.col("id").alias("b")).filter("a < b")
        groups = similar.similar_copies(numbered, id_column=ROW, words=5, least=0.8, candidates=candidates)
    first = groups.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias(ROW))
    return only(numbered, ROW, first).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences."""
    with small_batches(spark):
        found = packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER), end_id=END_ID, cache_words=CACHE_WORDS)
    return found.withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("language", in_known_languages),
    ("near_copies", one_of_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL can't run the models; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
