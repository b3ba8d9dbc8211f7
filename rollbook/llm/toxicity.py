"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on words of ordinary documents, one on those windows of toxic
documents that hold letter sequences which ordinary ones lack (each counted once per neighbouring word, so copies of a
document count once). A window is one word between blanks, followed by a fixed trailer, because zstandard finds no match in
the last bytes of a block. The window's length under either dictionary, together with its plain length, selects a calibrated
weight: the log ratio of toxic to ordinary training documents with such a window. A document's score is the logistic of
its heaviest window's distance from a threshold, which is set where training documents are told apart best.

Whole texts are scored. Null text, empty text and text without letters have no window; their score is that of weight 0.
Labels that are null are ignored, rows of one id are joined with every label row of it. Without labelled rows of both kinds
the model has no weights and calls nothing toxic. Repeated rows come back repeated, an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import kept, letters_of, slices, stored, text_or_empty, tidy

#: Labelled documents that the model is fitted on, at most; all of their text counts.
TOXIC_DOCS = 2000
ORDINARY_DOCS = 4000
#: Length of the letter sequences that choose toxic training windows.
GRAM = 5
LEVEL = 6
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 2_048
TRAILER = b"0x1F=27;{~48}[93]#57"
CACHE_WORDS = 150_000
#: What a window is weighed by: its length plain, under the ordinary and under the toxic dictionary.
LENGTHS = ("size", "plain", "toxic")
#: Name under which workers keep what only the fitting needs; scoring lets it go.
FIT = "toxicity fit"


def _window(word: str) -> bytes:
    return f" {word} ".encode()


def _grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; the samples themselves where there are too few to train on."""
    try:
        trained = zstandard.train_dictionary(size + 4096, samples, k=48, d=6).as_bytes()
        return trained[-min(size, len(trained) * 7 // 8) :]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Model:
    """Dictionaries, weights by (window length, length under either dictionary), and a threshold."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary + TRAILER, toxic + TRAILER)
        self.weights: dict[tuple[int, int, int], float] = {}
        self.threshold = math.inf
        self._start()

    def _start(self) -> None:
        self.cache: dict[str, float] = {}
        self.coders = []
        for content in self.contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **options))

    def __getstate__(self) -> dict:
        return {"contents": self.contents, "weights": self.weights, "threshold": self.threshold}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def lengths(self, word: str) -> tuple[int, int, int]:
        window = _window(word) + TRAILER
        return len(window), len(self.coders[0].compress(window)), len(self.coders[1].compress(window))

    def weight(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            found = self.cache[word] = self.weights.get(self.lengths(word), 0.0)
        return found

    def heaviest(self, texts: pa.Array) -> np.ndarray:
        """Weight of the heaviest window of each text, 0 at least."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        numbers, offsets, words = letters_of(texts)
        weights = np.fromiter(map(self.weight, words.to_pylist()), np.float64, len(words))[numbers]
        top = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            top[full] = np.maximum(0, np.maximum.reduceat(weights, offsets[full]))
        return top

    def scores(self, texts: pa.Array) -> np.ndarray:
        if math.isinf(self.threshold):
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-2 * (self.heaviest(texts) - self.threshold)))


def _summaries(texts: pa.Array) -> list[tuple[str, str]]:
    """Distinct words of each text without nulls, and distinct words with the one before, as `before,word`; both blank-joined."""
    out = []
    for begin, until in slices(texts):
        numbers, offsets, words = letters_of(texts[begin:until])
        names = ["", *words.to_pylist()]
        numbers = numbers.astype(np.int64) + 1
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = numbers[a:b]
            pairs = np.unique(np.concatenate([np.zeros(min(1, len(own)), np.int64), own[:-1]]) * len(names) + own)
            beside = " ".join(f"{names[p // len(names)]},{names[p % len(names)]}" for p in pairs.tolist())
            out.append((" ".join(sorted(names[i] for i in np.unique(own).tolist())), beside))
    return out


def _choosing_grams(column: str) -> Column:
    """As `_grams`, of a word column."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) + 3 - GRAM))
    return F.array_distinct(F.transform(places, lambda at: F.substring(F.concat(F.lit(" "), column, F.lit(" ")), at, F.lit(GRAM))))


def _least(toxic_docs: int) -> int:
    """Different words before it that a letter sequence needs to choose windows."""
    return max(3, toxic_docs // 200)


def _toxic_samples(chosen: list[tuple[str, int]]) -> list[bytes]:
    """Draws of a dozen windows; a word is drawn from as often as it has different words before it."""
    chosen, deal = sorted(chosen, key=lambda c: (c[1], c[0])), random.Random(1)
    ends = list(accumulate(n for _, n in chosen))
    drawn = (deal.sample(range(ends[-1]), min(12, ends[-1])) for _ in range(2000))
    return [b"".join(_window(chosen[bisect_right(ends, at)][0]) for at in some) for some in drawn]


def _weigh(model: Model, seen: list[Counter], docs: list[int]) -> None:
    """Set the weights, from the numbers of toxic and ordinary documents with each kind of window and of all."""
    for cell in seen[0].keys() | seen[1].keys():
        shares = [(counts[cell] + 0.5) / (n + 1) for counts, n in zip(seen, docs, strict=True)]
        model.weights[cell] = math.log(shares[0] / shares[1])


def _set_threshold(model: Model, tops: list[Counter]) -> None:
    """Set the threshold, from the numbers of toxic and ordinary documents by the weight of their heaviest window."""
    limits = np.array(sorted(tops[0].keys() | tops[1].keys()))
    limits = np.concatenate([limits, limits[-1:] + 1])
    found = [(np.fromiter(side.keys(), np.float64, len(side)), np.fromiter(side.values(), np.int64, len(side))) for side in tops]
    wrong = [found[0][1][found[0][0] < t].sum() + found[1][1][found[1][0] >= t].sum() for t in limits]
    best = int(np.argmin(wrong))
    model.threshold = float((limits[best] + limits[max(0, best - 1)]) / 2)


def fit(toxic_texts: list[str], ordinary_texts: list[str]) -> Model:
    """A model from a few labelled texts at hand; `fit_documents` takes the same steps in Spark."""
    found = [_summaries(text_or_empty(pa.array(texts, pa.string()))) for texts in (toxic_texts, ordinary_texts)]
    sides = [[words.split() for words, _ in side] for side in found]
    known = {g for words in sides[1] for w in words for g in _grams(w)}
    beside: dict[str, set[str]] = defaultdict(set)
    windows: dict[str, set[str]] = defaultdict(set)
    for _, pairs in found[0]:
        for before, word in (p.split(",") for p in pairs.split()):
            if fresh := _grams(word) - known:
                windows[word].add(before)
                for gram in fresh:
                    beside[gram].add(before)
    telling = {g for g, some in beside.items() if len(some) >= _least(len(sides[0]))}
    chosen = [(w, len(some)) for w, some in windows.items() if _grams(w) & telling]
    if not chosen or not sides[1]:
        return Model(b"", b"")
    plain = [f" {words}".encode() for words, _ in found[1] if words]
    model = Model(_dictionary(ORDINARY_BYTES, plain), _dictionary(TOXIC_BYTES, _toxic_samples(chosen)))
    kinds = [[{model.lengths(w) for w in words} for words in side] for side in sides]
    _weigh(model, [Counter(c for some in side for c in some) for side in kinds], [len(side) for side in kinds])
    _set_threshold(model, [Counter(max([0.0, *(model.weights[c] for c in some)]) for some in side) for side in kinds])
    return model


def _telling_words(sample: DataFrame, toxic_docs: int) -> list[tuple[str, int]]:
    """Words of toxic documents with a letter sequence that chooses windows, and how many different words come before each."""
    words = [sample.filter(F.col("label") == k).select(F.explode(F.split("words", " ")).alias("word")).filter("word <> ''").distinct() for k in (1, 0)]
    toxic, known = (side.select("word", F.explode(_choosing_grams("word")).alias("gram")) for side in words)
    fresh = stored(toxic.join(known.select("gram").distinct(), "gram", "left_anti"), "toxicity-grams")
    pairs = sample.filter("label = 1").select(F.explode(F.split("pairs", " ")).alias("pair"))
    pairs = pairs.select(F.substring_index("pair", ",", 1).alias("before"), F.substring_index("pair", ",", -1).alias("word"))
    pairs = stored(pairs.join(fresh.select("word").distinct(), "word", "left_semi").distinct(), "toxicity-neighbours")
    telling = fresh.join(pairs, "word").groupBy("gram").agg(F.count_distinct("before").alias("n")).filter(F.col("n") >= _least(toxic_docs))
    chosen = fresh.join(telling, "gram", "left_semi").select("word").distinct()
    return [(r.word, r.n) for r in pairs.join(chosen, "word").groupBy("word").agg(F.count("*").alias("n")).collect()]


def _ordinary_dictionary(sample: DataFrame) -> bytes:
    """Dictionary of the ordinary documents. It is trained by one call on all its samples, the distinct words of a bounded number of
    documents; a task does that, so they stay away from the driver."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(FIT, "train", object)
        samples = [f" {words}".encode() for batch in batches for words in batch.column(0).to_pylist() if words]
        found = pa.array([_dictionary(ORDINARY_BYTES, samples)], pa.binary())
        samples.clear()
        tidy()
        yield pa.RecordBatch.from_arrays([found], ["content"])

    rows = sample.filter("label = 0").repartition(1).sortWithinPartitions(*_order(), "words").select("words")
    return rows.mapInArrow(train, "content binary").collect()[0].content


def _windows_of(model: Model, sample: DataFrame) -> DataFrame:
    """Kinds of windows of each document, without repeats: number, label, and the three lengths."""
    name = uuid.uuid4().hex

    @F.arrow_udf("array<struct<size: int, plain: int, toxic: int>>")
    def kinds(texts: pa.Array) -> pa.Array:
        cells: dict[str, tuple[int, int, int]] = kept(FIT, name, dict)
        if len(cells) > CACHE_WORDS:
            cells.clear()
        out = []
        for text in texts.to_pylist():
            own = {cells.get(w) or cells.setdefault(w, model.lengths(w)) for w in text.split()}
            out.append([dict(zip(LENGTHS, cell, strict=True)) for cell in own])
        return pa.array(out, pa.list_(pa.struct([(n, pa.int32()) for n in LENGTHS])))

    return sample.select("number", "label", F.explode(kinds("words")).alias("w")).select("number", "label", "w.*")


def _order(id_column: str = "id") -> tuple[Column, Column]:
    """Order in which documents are chosen, and in which they train."""
    return F.xxhash64(F.lit("fit"), id_column), F.col(id_column)


def fit_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    toxic_docs: int = TOXIC_DOCS,
    ordinary_docs: int = ORDINARY_DOCS,
) -> Model:
    """A model from at most `toxic_docs` and `ordinary_docs` labelled documents, chosen by the hash of their id.

    The ids are chosen from the labels alone. Tasks read the whole texts of the sample and store the distinct words of each document,
    and of toxic ones those with the word before. Spark counts over that table; what reaches the driver is the telling words, a
    dictionary, and document counts by kind of window and by weight, but no document's words.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")).dropna().distinct()
    picked = [marks.filter(F.col("label") == k).orderBy(*_order()).limit(n) for k, n in ((1, toxic_docs), (0, ordinary_docs))]

    @F.arrow_udf("words string, pairs string")
    def summary(texts: pa.Array) -> pa.Array:
        kept(FIT, "summary", object)
        found = _summaries(text_or_empty(texts))
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["words", "pairs"])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").select("id", "label", summary("text").alias("s"))
    found = found.select("id", "label", "s.words", F.when(F.col("label") == 1, F.col("s.pairs")).alias("pairs"))
    sample = stored(found.withColumn("number", F.monotonically_increasing_id()), "toxicity-sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    sizes = [sizes.get(k, 0) for k in (1, 0)]
    chosen = _telling_words(sample, sizes[0]) if all(sizes) else []
    if not chosen:
        return Model(b"", b"")
    model = Model(_ordinary_dictionary(sample), _dictionary(TOXIC_BYTES, _toxic_samples(chosen)))
    windows = stored(_windows_of(model, sample), "toxicity-windows")
    counts = windows.groupBy("label", *LENGTHS).count().collect()
    _weigh(model, [Counter({(r["size"], r.plain, r.toxic): r["count"] for r in counts if r.label == k}) for k in (1, 0)], sizes)
    weights = spark.createDataFrame([(*cell, weight) for cell, weight in model.weights.items()], "size int, plain int, toxic int, weight double")
    heaviest = windows.join(F.broadcast(weights), list(LENGTHS)).groupBy("label", "number").agg(F.greatest(F.lit(0.0), F.max("weight")).alias("top"))
    rows = heaviest.groupBy("label", "top").count().collect()
    tops = [Counter({r.top: r["count"] for r in rows if r.label == k}) for k in (1, 0)]
    for side, n in zip(tops, sizes, strict=True):
        if n > side.total():
            side[0.0] += n - side.total()  # documents without a word
    _set_threshold(model, tops)
    tidy()
    return model


def toxicity(model: Model, column: str | Column) -> Column:
    """Score 0 to 1 of a text column."""

    name = uuid.uuid4().hex

    def of(texts: pa.Array) -> pa.Array:
        own, plain = kept("toxicity", name, lambda: model), text_or_empty(texts)
        return pa.array(np.concatenate([np.zeros(0), *(own.scores(plain[a:b]) for a, b in slices(plain))]))

    text = F.col(column) if isinstance(column, str) else column
    return F.arrow_udf(of, "double")(text.cast("string"))
