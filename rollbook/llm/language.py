"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each letter of a word and the blank behind it from up to `ORDER` - 1 characters before, the
leading blank included. All languages share one sorted array of hashed n-grams per order (the hash is an odd multiple of
the packed characters, so different n-grams never meet), with a log probability and a back-off weight per language. The
language with the lowest cross-entropy per character is chosen. A document is rejected if that cross-entropy lies above the
language's mean by more than `ROOM` of the way to random characters and the largest deviation of a training document, which
is measured in standard errors, so short texts get the room they need.

Words are scored once per worker and whole texts are sums of their words. Null text and text without a letter are `und`
with score 0 and rejected. Ties go to the first language in sorted order. Rows without language are not learned from;
without any training row every text is `und`. Repeated rows come back repeated.
"""

from __future__ import annotations

import copy
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import hashed_share, kept, letters_of, slices, sums, text_or_empty, tidy

ORDER = 4
BITS = 16
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Training documents of each language, about; all of their text counts.
DOCS_PER_LANGUAGE = 1000
CACHE_WORDS = 150_000
#: Bytes of text that a task scores at a time.
SCORED_BYTES = 1 << 20
#: Share of the way from a language's mean cross-entropy to that of random characters that every document may go.
ROOM = 0.4
BLANK = 1
UNKNOWN = "und"


def _spread(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all words with a blank before each and behind the last; word and depth of each character."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    chars = codes[points].astype(np.uint64)
    blanks = np.flatnonzero(points == 32)
    behind = np.searchsorted(blanks, np.arange(len(points)), "left")  # blanks before the character
    word = behind - 1
    depth = np.arange(len(points)) - blanks[np.maximum(word, 0)]
    return chars, word.astype(np.int32), depth.astype(np.int32)


def _packed(chars: np.ndarray, order: int) -> np.ndarray:
    """Key of the `order` characters up to each place; shorter at the start, where it is not used."""
    keys = np.zeros(len(chars), np.uint64)
    for back in range(order - 1, -1, -1):
        keys <<= np.uint64(BITS)
        keys[back:] |= chars[: len(chars) - back]
    return keys


class Model:
    """N-gram tables of all languages."""

    def __init__(self, languages: list[str], words: list[tuple[list[str], np.ndarray]]):
        self.languages = languages
        self.mean = np.zeros(len(languages))
        self.deviation = np.ones(len(languages))
        self.limit = np.full(len(languages), np.inf)
        self.room = np.zeros(len(languages))
        self._fit(words)
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _fit(self, words: list[tuple[list[str], np.ndarray]]) -> None:
        letters = sorted({c for some, _ in words for w in some for c in w})[: (1 << BITS) - 2]
        self.codes = np.zeros(0x110000, np.uint16)
        self.codes[32] = BLANK
        self.codes[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        spread = [_spread(some, self.codes) for some, _ in words]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for order in range(1, ORDER + 1):
            row = []
            for (chars, word, depth), (_, counts) in zip(spread, words, strict=True):
                here = (depth >= max(1, order - 1)) if order > 1 else depth >= 1
                keys, at = np.unique(_packed(chars, order)[here], return_inverse=True)
                row.append((keys, np.bincount(at, counts[word[here]], len(keys))))
            found.append(row)
        del spread
        self.keys, self.logs, self.backs = [], [], []
        lower: np.ndarray | None = None
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([k for k, _ in found[order - 1]] or [np.zeros(0, np.uint64)]))
            mask = np.uint64((1 << (BITS * (order - 1))) - 1)
            contexts, context = np.unique(union >> np.uint64(BITS), return_inverse=True)
            starts_blank = (union >> np.uint64(BITS * (order - 1))) == BLANK
            logs = np.zeros((len(union), len(words)))
            backs = np.zeros((len(contexts), len(words)))
            suffix = np.searchsorted(below, union & mask) if order > 1 else None  # noqa: F821
            for n in range(len(words)):
                keys, counts = found[order - 1][n]
                own = np.zeros(len(union))
                own[np.searchsorted(union, keys)] = counts
                if order < ORDER:  # continuation counts, but for what a word starts with
                    wider = found[order][n][0] & np.uint64((1 << (BITS * order)) - 1) if order < 4 else found[order][n][0]
                    follow, times = np.unique(wider, return_counts=True)
                    at = np.searchsorted(union, follow)
                    kinds = np.zeros(len(union))
                    kinds[at] = times
                    own = np.where(starts_blank & (order > 1), own, kinds)
                ones, twos = (own == 1).sum(), (own == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                discount = min(max(discount, 0.1), 0.9)
                total = np.bincount(context, own, len(contexts))
                types = np.bincount(context, own > 0, len(contexts))
                rest = np.where(total > 0, discount * types / np.maximum(total, 1e-9), 1.0)
                rest = np.clip(rest, 1e-6, 1.0)
                backs[:, n] = np.log(rest)
                base = lower[suffix, n] if order > 1 else np.full(len(union), -np.log(len(letters) + 2))
                share = np.maximum(own - discount, 0) / np.maximum(total[context], 1e-9)
                logs[:, n] = np.log(share + rest[context] * np.exp(base))
            hashed = union * ODD
            sort = np.argsort(hashed)
            self.keys.append(hashed[sort])
            self.logs.append(logs[sort].astype(np.float32))
            hashed = contexts * ODD
            sort = np.argsort(hashed)
            self.backs.append((hashed[sort], backs[sort].astype(np.float32)))
            below, lower = union, logs

    def _word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word, its closing blank included, per language."""
        chars, word, depth = _spread(words, self.codes)
        total = np.full((len(chars), len(self.languages)), -np.log(len(self.codes[self.codes > 0]) + 2.0))
        if len(self.backs[0][0]):
            total += self.backs[0][1][0]
        for order in range(1, ORDER + 1):
            keys = _packed(chars, order)
            here = np.flatnonzero(depth >= max(1, order - 1))
            distinct, back = np.unique(keys[here], return_inverse=True)
            hashed = distinct * ODD
            at = np.minimum(np.searchsorted(self.keys[order - 1], hashed), len(self.keys[order - 1]) - 1)
            hit = self.keys[order - 1][at] == hashed
            if order > 1:
                over, weights = self.backs[order - 1]
                above = (distinct >> np.uint64(BITS)) * ODD
                place = np.minimum(np.searchsorted(over, above), len(over) - 1)
                added = np.where((over[place] == above)[:, None], weights[place], 0)
            else:
                added = np.zeros((len(distinct), len(self.languages)))
            total[here] = np.where(hit[back][:, None], self.logs[order - 1][at[back]], total[here] + added[back])
        kept = np.flatnonzero(depth >= 1)
        out = np.zeros((len(words), len(self.languages)))
        for n in range(len(self.languages)):
            out[:, n] = np.bincount(word[kept], total[kept, n], len(words))
        return out

    def _scores(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._start()
            fresh = words
        if fresh:
            first = len(self.known)
            self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            if first + len(fresh) > len(self.table):
                grown = np.zeros((max(1024, 2 * (first + len(fresh))), len(self.languages)))
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first : first + len(fresh)] = self._word_scores(fresh)
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: und), score, cross-entropy and predicted characters of each text."""
        numbers, offsets, distinct = letters_of(texts)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        entropy, size = np.zeros(len(texts)), np.zeros(len(texts))
        if not len(distinct) or not self.languages:
            return best, score, entropy, size
        words = distinct.to_pylist()
        each = self._scores(words)
        size = sums(np.fromiter(map(len, words), np.float64, len(words))[numbers] + 1, offsets)
        total = np.stack([sums(each[numbers, n], offsets) for n in range(len(self.languages))], 1)
        full = size > 0
        per = -total / np.maximum(size, 1)[:, None]
        best = np.where(full, per.argmin(1), -1)
        chance = np.exp(np.clip(total - total.max(1)[:, None], -60, 0))
        score = np.where(full, 1 / chance.sum(1), 0.0)
        entropy = np.where(full, per.min(1), 0.0)
        return best, score, entropy, size


RESULT = "lang_pred string, score double, cross_entropy double, characters long, rejected boolean"


def language(held, column: str | Column) -> Column:  # noqa: ANN001
    """Struct column `RESULT` of a text column; `held` is a broadcast Model."""

    name = uuid.uuid4().hex

    def of(texts: pa.Array) -> pa.Array:
        # the broadcast holds the tables, the worker's own copy the words as well
        model, plain = kept("language", name, lambda: copy.copy(held.value)), text_or_empty(texts)
        parts = [model.judge(plain[a:b]) for a, b in slices(plain, SCORED_BYTES)]
        best, score, entropy, size = (np.concatenate([np.zeros(0), *(p[i] for p in parts)]) for i in range(4))
        at = best.astype(np.int64)
        names = pa.array([model.languages[i] if i >= 0 else UNKNOWN for i in at.tolist()], pa.string())
        far = np.ones(len(at), bool)
        if model.languages:
            error = model.deviation[at] / np.sqrt(np.maximum(size, 1))
            far = (at < 0) | (entropy - model.mean[at] > model.room[at] + model.limit[at] * error)
        columns = [names, pa.array(score), pa.array(entropy), pa.array(size.astype(np.int64)), pa.array(far)]
        return pa.StructArray.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    text = F.col(column) if isinstance(column, str) else column
    return F.arrow_udf(of, RESULT)(text.cast("string"))


def fit_documents(docs: DataFrame, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE):  # noqa: ANN201
    """A broadcast model from about `docs_per_language` documents of each language, chosen by the hash of their id.

    What reaches the driver is the words of that sample with their counts; its size does not depend on the corpus. The limits of
    rejection come from the sample as well.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(language_column).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return context.broadcast(Model([], []))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, docs_per_language / n))) for k, n in sizes.items()])
    sample = rows.filter(hashed_share("id", share))
    split = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = sample.select("lang", split.alias("word")).filter("word <> ''").groupBy("lang", "word").count().orderBy("lang", "word").toArrow()
    languages = sorted(pc.unique(counts["lang"]).to_pylist())
    groups = [counts.filter(pc.equal(counts["lang"], k)) for k in languages]
    model = Model(languages, [(g["word"].to_pylist(), g["count"].to_numpy().astype(np.float64)) for g in groups])
    del counts, groups
    tidy()
    if not languages:
        return context.broadcast(model)
    first = context.broadcast(model)
    judged = sample.select("lang", language(first, "text").alias("r")).filter("r.lang_pred = lang")
    judged = judged.select("lang", F.col("r.cross_entropy").alias("e"), F.col("r.characters").alias("n"))
    mean = judged.groupBy("lang").agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("mean"))
    off = judged.join(F.broadcast(mean), "lang").withColumn("off", (F.col("e") - F.col("mean")) * F.sqrt("n"))
    spread = off.groupBy("lang").agg(F.first("mean").alias("mean"), F.sqrt(F.avg(F.col("off") ** 2)).alias("deviation"), F.max("off").alias("most"))
    for row in spread.collect():
        n = languages.index(row.lang)
        model.mean[n], model.deviation[n] = row["mean"], max(row.deviation, 1e-6)
        model.limit[n] = max(3.0, row.most / model.deviation[n])
        model.room[n] = ROOM * max(0.0, np.log((model.codes > 0).sum()) - model.mean[n])
    first.destroy()
    final = context.broadcast(model)
    del model
    tidy()
    return final
