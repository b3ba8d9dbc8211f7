"""Quality by the votes of the nearest labelled texts in a latent-semantic space.

A text becomes counts of hashed terms: its words in lower case, the shapes of its words (runs of capitals, small letters and
digits, with all other characters as they are), words equal to the one before, and how much of the text its distinct words make up.
Counts are damped, weighted by the rarity of the term over all documents, and projected on the strongest directions of the labelled
sample's matrix. The labelled vectors are broadcast; every document's cosine with all of them is computed exactly, block by block,
and the nearest ones vote for their label by weight `similarity ** SHARPNESS`, corrected for how much of its label was drawn.

Term rarity is counted over all documents. The sample is bounded by `PER_LABEL` rows of each label, chosen by the hash of their
id, so the broadcast is bounded: at most 2 x PER_LABEL vectors of DIRECTIONS numbers, and TERMS x DIRECTIONS of the projection.

Null and empty texts, and any text without a term the model knows, have no direction: their score is the share of label 1 among
the labelled. Null labels count as no label, a row with several labels takes part once for each. Without labelled rows every score
is 0.5, with one kind only every score is that label. Equal texts have equal scores; repeated rows come back repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import kept, slices, stored, text_or_empty, tidy, words_of

#: Hashed terms, directions of the latent space, labelled rows of each label at most, neighbours that vote.
TERMS = 2048
DIRECTIONS = 64
PER_LABEL = 2048
NEIGHBOURS = 15
SHARPNESS = 4
#: Documents and labelled vectors of one block of products.
BLOCK = 1024
#: Similarities are compared in steps of this size, so that equal texts meet equal neighbours wherever they stand.
STEP = 1 << 16
COUNTS = "struct<terms:array<smallint>,counts:array<int>>"


def _buckets(kind: str, names: pa.Array) -> np.ndarray:
    """Hash bucket of each name; the first eight buckets are kept for counts that are no names."""
    text = np.array([f"{kind} {n}" for n in names.to_pylist()], dtype=object)
    return (8 + pd.util.hash_array(text, categorize=False) % (TERMS - 8)).astype(np.int64)


def _shapes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each word's shape, and the shapes."""
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}]+", "a"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, mark)
    coded = pc.utf8_slice_codeunits(words, 0, 16).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _slice_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the texts of a slice, in the order of rows and terms."""
    numbers, offsets, words = words_of(texts)
    if not len(numbers):
        return (np.zeros(0, np.int64),) * 3
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    lower = pc.utf8_lower(words).dictionary_encode()
    word_terms = _buckets("word", lower.dictionary)[lower.indices.to_numpy(zero_copy_only=False)]
    shape_of, shapes = _shapes(words)
    shape_terms = _buckets("shape", shapes)[shape_of]
    found = [rows * TERMS + word_terms[numbers], rows * TERMS + shape_terms[numbers]]
    again = np.flatnonzero((numbers[1:] == numbers[:-1]) & (rows[1:] == rows[:-1])) + 1
    found.append(rows[again] * TERMS)
    # how varied the text is: distinct words in quarters of all words, as one of the terms 1 to 4
    distinct = np.bincount(np.unique(rows * len(words) + numbers) // len(words), minlength=len(texts))
    total = np.diff(offsets)
    held = np.flatnonzero(total)
    found.append(np.repeat(held * TERMS + 1 + np.minimum(3, 4 * distinct[held] // total[held]), 4))
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    return keys // TERMS, keys % TERMS, counts


def term_counts(column: str | Column) -> Column:
    """Terms of a text and how often it has each, as `COUNTS`."""

    def of(texts: pa.Array) -> pa.Array:
        kept("neighbours", "terms", object)
        plain = text_or_empty(texts)
        parts = [(a, *_slice_counts(plain[a:b])) for a, b in slices(plain)]
        rows = np.concatenate([np.zeros(0, np.int64), *(a + r for a, r, _, _ in parts)])
        terms = np.concatenate([np.zeros(0, np.int64), *(t for _, _, t, _ in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, _, _, c in parts)])
        offsets = pa.array(np.searchsorted(rows, np.arange(len(plain) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (terms.astype(np.int16), counts.astype(np.int32))]
        return pa.StructArray.from_arrays(lists, ["terms", "counts"])

    text = F.col(column) if isinstance(column, str) else column
    return F.arrow_udf(of, COUNTS)(text.cast("string"))


def rarity(counted: DataFrame) -> np.ndarray:
    """Inverse document frequency of every term, over all rows with `terms`; the table has `TERMS` rows at most."""
    seen = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    frequency = np.zeros(TERMS)
    for r in seen:
        frequency[r.term] = r.n
    return np.log((counted.count() + 1) / (frequency + 1)).astype(np.float32)


def dense(terms: pa.Array, counts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Rows of damped, weighted term counts."""
    offsets = terms.offsets.to_numpy()
    rows = np.repeat(np.arange(len(terms)), np.diff(offsets))
    columns = terms.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(terms), TERMS), np.float32)
    out[rows, columns] = (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * idf[columns]
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of length 0 stay."""
    lengths = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(lengths > 0, lengths, 1)


@dataclass
class Model:
    """Term weights, projection, labelled vectors (a row each), their labels and the weight of each vote."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the nearest labelled vectors of each query, exactly; of equal ones the earlier."""
        best = np.full((len(queries), 0), 0, np.int64)
        many = len(self.vectors)
        for begin in range(0, many, BLOCK):
            steps = np.rint(queries @ self.vectors[begin : begin + BLOCK].T * STEP).astype(np.int64)
            ranked = (steps + STEP) * many + (many - 1 - np.arange(begin, begin + steps.shape[1]))
            best = np.concatenate([best, ranked], 1)
            if best.shape[1] > NEIGHBOURS:
                best = -np.partition(-best, NEIGHBOURS - 1, 1)[:, :NEIGHBOURS]
        best = -np.sort(-best, 1)
        return many - 1 - best % many, (best // many - STEP) / STEP

    def scores(self, terms: pa.Array, counts: pa.Array) -> np.ndarray:
        """Share of label 1 in the votes of the nearest labelled vectors."""
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        out = []
        for begin in range(0, len(terms), BLOCK):
            queries = unit(dense(terms[begin : begin + BLOCK], counts[begin : begin + BLOCK], self.idf) @ self.basis)
            numbers, similar = self.nearest(queries)
            votes = np.maximum(similar, 0) ** SHARPNESS * self.weights[numbers]
            total = votes.sum(1)
            share = (votes * self.labels[numbers]).sum(1) / np.where(total > 0, total, 1)
            out.append(np.where(total > 0, share, self.prior))
        return np.concatenate([np.zeros(0), *out])


def fit(rows: pa.Table, idf: np.ndarray, drawn: dict[int, float]) -> Model:
    """A model from labelled rows (terms, counts, label); `drawn` is the number of labelled rows that each drawn one stands for."""
    labels = rows["label"].to_numpy().astype(np.float64)
    weights = np.array([drawn[int(k)] for k in labels])
    prior = float((weights * labels).sum() / weights.sum()) if len(labels) else 0.5
    if len(set(labels)) < 2:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels[:0], weights[:0], prior)
    matrix = unit(dense(rows["terms"].combine_chunks(), rows["counts"].combine_chunks(), idf))
    # directions of the labelled texts, each kind weighing as much as among all labelled rows
    weighted = matrix * np.sqrt(weights / weights.sum())[:, None].astype(np.float32)
    values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    best = np.argsort(-values)[:DIRECTIONS]
    basis = vectors[:, best[values[best] > 1e-12]].astype(np.float32)
    return Model(idf, basis, unit(matrix @ basis), labels, weights, prior)


def fit_counted(counted: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", per_label: int = PER_LABEL) -> Model:
    """A model from the labelled rows of a table with `term_counts` as `found`; rarity comes from all rows of the table."""
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).dropna().distinct()
    marks = marks.where(F.col("label").isin(0, 1))
    known = counted.select(F.col(id_column).alias("id"), "found.*")
    idf = rarity(known)
    of_label = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64(F.lit("neighbours"), "id"), F.col("id"))
    picked = [marks.where(F.col("label") == k).orderBy(*order).limit(per_label) for k in (0, 1)]
    drawn = known.join(F.broadcast(picked[0].unionByName(picked[1])), "id").orderBy("label", *order, "terms", "counts")
    rows = drawn.select("terms", "counts", "label").toArrow()
    model = fit(rows, idf, {k: max(1.0, n / per_label) for k, n in of_label.items()})
    del rows
    tidy()
    return model


def score(counted: DataFrame, model: Model, column: str = "found") -> Column:
    """Score 0 to 1 of the texts counted in a column; the model is broadcast."""
    name = uuid.uuid4().hex
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def of(found: pa.Array) -> pa.Array:
        own = kept("neighbours", name, lambda: shared.value)
        return pa.array(own.scores(found.field("terms"), found.field("counts")))

    return F.arrow_udf(of, "double")(F.col(column))


def counted_texts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns but the text, and its term counts as `found`, stored: the texts are read once."""
    return stored(docs.withColumn("found", term_counts(text_column)).drop(text_column), "term-counts")
