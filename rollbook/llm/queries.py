"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import conversations, language, media, merkle, neighbours, ngram_trie, packing, quality, secrets, sentencepieces, simhash, token_files, toxicity
from rollbook.llm.oracles import CONVERSATION_TRIE, MERKLE_MANIFEST
from rollbook.llm.shared import fold

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
END_ID = 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF; payload, checks and features read back from the stored bytes."""
    kept = media.stored_text_media(documents(spark, sf_dir))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", media.media_digest("media").alias("read")).select("doc_id", "n_bytes", "read.*")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2048 ids."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), end_id=END_ID).withColumnRenamed("id", "doc_id")


def op3_perfect_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as id files in the order of doc_id, found again through the perfect hash index."""
    docs = documents(spark, sf_dir)
    files = token_files.write(docs, public_tokenizers.path(WORD_TOKENIZER), end_id=END_ID)
    return files.read(docs, "doc_id").withColumnRenamed("key", "doc_id")


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all texts, learned from labelled documents outside fold 0 of 5."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = fold("doc_id", 5) != 0
    model = toxicity.fit_documents(docs.filter(learned), labels.filter(learned))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all texts and the verdict of the voting rules."""
    judged = quality.judge(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "quality")


def op6_simhash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the smallest doc_id each one reaches over links of up to 4 bits."""
    found = simhash.near_copies(documents(spark, sf_dir), words=4, bits=4)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex("fingerprint").alias("fingerprint"), "component_id")


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all texts: by pattern, and runs that the randomness battery finds."""
    found = secrets.find(documents(spark, sf_dir))
    counts = [F.size(f"secret_{kind}").cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(secrets.listed("secret_base").cast("binary"), 256).alias("base_sha256"),
        secrets.listed("secret_spans").alias("spans"),
    )


def op8_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all texts, learned from documents outside fold 2 of 4."""
    docs = documents(spark, sf_dir)
    model = language.fit_documents(docs.filter(fold("doc_id", 4) != 2))
    judged = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), language.language(model, "text").alias("r"))
    return judged.select("doc_id", "held_out", "r.*")


def op9_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded with the SentencePiece model, with agreement of both libraries."""
    coded = sentencepieces.round_trip(public_tokenizers.path(PIECE_MODEL), "text")
    return documents(spark, sf_dir).select("doc_id", coded.alias("r")).select("doc_id", "r.*")


def op10_ngram_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all texts, learned from documents outside fold 1 of 5."""
    docs = documents(spark, sf_dir)
    trie = ngram_trie.train(docs.filter(fold("doc_id", 5) != 1))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), ngram_trie.score(trie, "text").alias("r"))
    tokens = F.lit(trie.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "r.n_tokens", "r.n_known", tokens, "r.base_score", "r.score")


def op11_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts by their nearest labelled ones, learned from documents outside fold 0 of 5."""
    counted = neighbours.counted_texts(documents(spark, sf_dir).select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = neighbours.fit_counted(counted, labels.filter(fold("doc_id", 5) != 0))
    scored = counted.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), neighbours.score(counted, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt so that each shares up to three first turns with the one its twenty begin with."""
    rows = conversations.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = conversations.trie(conversations.with_shared_starts(rows, every=20, most=4))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, trees and proofs of all documents, checked against texts of which every third one's capitals were lowered."""
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.when(fold("doc_id", 3) == 0, merkle.leaf_of("doc_id", "source", "lang", "n_chars", lowered))
    return merkle.manifest(documents(spark, sf_dir), tampered).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_gif_media, op2_best_fit_packing, op3_perfect_hash_files, op4_compression_toxicity, op5_weak_supervision, op6_simhash_copies, op7_secret_spans, op8_kneser_ney_language, op9_piece_round_trip, op10_ngram_trie_scores, op11_neighbour_quality, op12_conversation_trie, op13_merkle_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op12_conversation_trie": CONVERSATION_TRIE, "op13_merkle_manifest": MERKLE_MANIFEST}
