"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Level 1 is the vocabulary: sorted 64-bit word hashes with counts, in files by the hash's leading bits; a word's number is its
rank. Level 2 holds, for each context word, its successors: in every file the contexts and the pointers to their ranges are
Elias-Fano sequences, and the successors are one too, made increasing by their context's rank. A pair is found by the
context-relative successor search in that sequence; its probability is a 16-bit code. Pairs are dealt over the files by
hash, so a word behind a third of the tokens fills no single one.

P(w | h) = (c(hw) + k P(w)) / (c(h) + k) with P(w) = (c + 0.5) / (N + 0.5 (V + 1)); k is the candidate with the highest
leave-one-out likelihood of the training pairs. A document's first word has the end token as its context.

All counts cover every training document, by Spark: tasks count in slices, counts meet by hash. The files lie in the shared
folder and are memory-mapped by the scoring tasks. Different words meet only if their 64-bit hashes do.

Null text counts as empty: one token, the end. Repeated rows count and come back repeated. Without training rows every word
is unknown. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.elias_fano import EliasFano
from rollbook.llm.shared import kept, new_folder, open_arrays, slices, stored, sums, text_or_empty, words_of, write_arrays

#: A word never holds a blank, so this is the hash of no word.
END_HASH = xxhash.xxh64_intdigest(b" ")
VOCABULARY_BITS = 4
TOKENS_PER_FILE = 2_000_000
SLICE = 4 << 20
#: Pairs that a counting task gathers before it hands them on.
HELD_PAIRS = 1_500_000
WEIGHTS = (0.5, 2.0, 10.0, 50.0, 250.0, 1000.0, 5000.0, 25000.0, 125000.0)
SCALE = 4096.0


def _hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token behind each text, and the offsets of the texts."""
    numbers, offsets, words = words_of(pc.ascii_lower(texts))
    own = _hashes(words)[numbers]
    return np.insert(own, offsets[1:], np.uint64(END_HASH)), offsets + np.arange(len(offsets))


def _count(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    sort = np.argsort(keys, kind="stable")
    keys, counts = keys[sort], counts[sort]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _counted(texts: DataFrame, keys_of, name: str, files: int = 1) -> DataFrame:  # noqa: ANN001
    """Rows (key, n, file) of a task's texts, counted per task as far as memory allows; not yet summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _count(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 500_000):
                part = keys[at : at + 500_000]
                columns = [part.view(np.int64), counts[at : at + 500_000], file_of(part, files).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [name, "n", "file"])

        for batch in batches:
            plain = text_or_empty(batch.column(0))
            for begin, until in slices(plain, SLICE):
                keys = keys_of(plain[begin:until])
                held.append(_count(keys, np.ones(len(keys), np.int64)))
                size += len(held[-1][0])
                pa.default_memory_pool().release_unused()
                if size > HELD_PAIRS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return texts.mapInArrow(run, f"{name} long, n long, file int")


@dataclass
class Trie:
    """Where a trie lies, and the few numbers that describe it."""

    folder: str
    bases: list[int]  # number of the first word of each vocabulary file
    files: int  # of pairs
    tokens: int
    words: int
    weight: float = 0.0

    def vocabulary(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return kept(self.folder, "words", self._vocabulary)

    def _vocabulary(self) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [open_arrays(f"{self.folder}/words-{i}") if n else None for i, n in enumerate(np.diff([*self.bases, self.words]))]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return [(p["hashes"], p["counts"]) if p else empty for p in parts]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number (-1: unknown) and count of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        cuts = np.searchsorted(distinct >> np.uint64(64 - VOCABULARY_BITS), np.arange(len(self.bases) + 1))
        for base, (known, counts), begin, until in zip(self.bases, self.vocabulary(), cuts[:-1], cuts[1:], strict=True):
            if begin == until or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, distinct[begin:until]), len(known) - 1)
            hit = known[at] == distinct[begin:until]
            number[begin:until] = np.where(hit, base + at, -1)
            count[begin:until] = np.where(hit, counts[at], 0)
        return number[back], count[back]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def pairs(self, values: np.ndarray) -> np.ndarray:
        """log10 probability of each context * words + word; NaN where the pair is not in the trie."""
        distinct, back = np.unique(values, return_inverse=True)
        logs = np.full(len(distinct), np.nan)
        place = file_of(distinct, self.files)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(self.files + 1))
        for number in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[number] : cuts[number + 1]]
            level = kept(self.folder, f"pairs-{number}", lambda n=number: Level(open_arrays(f"{self.folder}/pairs-{n}")))
            logs[own] = level.find(distinct[own], self.words)
        return logs[back]


def file_of(values: np.ndarray, files: int) -> np.ndarray:
    """Which file holds a pair: the leading bits of a product, so neighbouring values are spread."""
    mixed = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return ((mixed * np.uint64(files)) >> np.uint64(31)).astype(np.int64)


class Level:
    """One file of pairs: contexts, pointers, successors and probability codes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.contexts, self.pointers, self.successors = (EliasFano(arrays, p) for p in ("context_", "pointer_", "successor_"))
        self.codes = arrays["codes"]

    @staticmethod
    def build(values: np.ndarray, logs: np.ndarray, words: int) -> dict[str, np.ndarray]:
        contexts, starts = np.unique(values // words, return_index=True)
        ranks = np.repeat(np.arange(len(contexts)), np.diff([*starts, len(values)]))
        arrays = EliasFano.build(contexts, "context_")
        arrays |= EliasFano.build(np.append(starts, len(values)), "pointer_")
        arrays |= EliasFano.build(ranks * words + values % words, "successor_")
        return arrays | {"codes": np.clip(np.rint(-logs * SCALE), 0, 65535).astype(np.uint16)}

    def find(self, values: np.ndarray, words: int) -> np.ndarray:
        """log10 probabilities of increasing values; NaN where there is no such pair."""
        contexts, back = np.unique(values // words, return_inverse=True)
        rank, known = self.contexts.successor(contexts)
        logs = np.full(len(values), np.nan)
        held = np.flatnonzero(known[back])
        if not len(held):
            return logs
        begin, end = self.pointers[rank[known]], self.pointers[rank[known] + 1]
        own = (np.cumsum(known) - 1)[back[held]]
        place, same = self.successors.successor(rank[back[held]] * words + values[held] % words)
        same &= (place >= begin[own].astype(np.int64)) & (place < end[own].astype(np.int64))
        logs[held[same]] = self.codes[place[same]] / -SCALE
        return logs


def _pair_values(trie: Trie, texts: pa.Array) -> np.ndarray:
    hashes, offsets = token_hashes(texts)
    numbers, _ = trie.numbers(hashes)
    end, _ = trie.numbers(np.array([END_HASH], np.uint64))
    before = np.concatenate([end, numbers[:-1]])
    before[offsets[:-1]] = end[0]
    return before * trie.words + numbers


def train(texts: DataFrame, text_column: str = "text", tokens_per_file: int = TOKENS_PER_FILE) -> Trie:
    """Count all texts and write the levels to a new folder below the shared one."""
    spark = texts.sparkSession
    source = texts.select(F.col(text_column).cast("string").alias("text"))
    folder = new_folder(spark, "trie")
    parts = 1 << VOCABULARY_BITS

    def words_of_task(plain: pa.Array) -> np.ndarray:
        return token_hashes(plain)[0]

    counted = _counted(source, words_of_task, "hash").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = stored(counted.withColumn("part", F.shiftrightunsigned("hash", 64 - VOCABULARY_BITS)), "word-counts")
    sizes = {r.part: (r.words, r.tokens) for r in counted.groupBy("part").agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()}
    per_part = [sizes.get(i, (0, 0)) for i in range(parts)]
    bases = np.concatenate([[0], np.cumsum([w for w, _ in per_part])]).tolist()
    trie = Trie(folder, bases[:-1], 1, sum(t for _, t in per_part), bases[-1])
    trie.files = max(1, -(-trie.tokens // tokens_per_file))
    if not trie.tokens:
        return trie

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            part, hashes = table["part"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
            for number in np.unique(part).tolist():
                own = np.flatnonzero(part == number)
                own = own[np.argsort(hashes[own])]
                write_arrays(f"{folder}/words-{number}", {"hashes": hashes[own], "counts": table["n"].to_numpy()[own]})
                yield pa.RecordBatch.from_arrays([pa.array([number])], ["part"])

    written = counted.repartition(parts, "part").mapInArrow(write_words, "part long").count()
    if written != len(sizes):
        raise RuntimeError("vocabulary files are missing")
    files = trie.files

    def pairs_of_task(plain: pa.Array) -> np.ndarray:
        return _pair_values(trie, plain)

    dealt = _counted(source, pairs_of_task, "value", files)
    words = trie.words

    def write_raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs and counts of the files of a task, and the leave-one-out likelihood of each weight."""
        for number, keys, counts in _runs(batches):
            context, word = keys // words, keys % words
            flat = np.concatenate([c for _, c in trie.vocabulary()])
            total, chance = flat[context], trie.unigram(flat[word])
            gain = [float((counts * np.log((counts - 1 + k * chance) / (total - 1 + k))).sum()) for k in WEIGHTS]
            write_arrays(f"{folder}/raw-{number}", {"values": keys, "counts": counts})
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([gain], pa.list_(pa.float64()))], ["file", "gain"])

    # the sort brings a file's rows together; its pairs are at most tokens_per_file on average
    ordered = dealt.repartition(files, "file").sortWithinPartitions("file", "value").select("file", "value", "n")
    gains = stored(ordered.mapInArrow(write_raw, "file int, gain array<double>"), "gains")
    sums_of = gains.agg(*[F.sum(F.col("gain")[i]).alias(str(i)) for i in range(len(WEIGHTS))]).first()
    trie.weight = WEIGHTS[int(np.argmax(list(sums_of)))]

    def write_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                raw = open_arrays(f"{folder}/raw-{number}")
                keys, counts = raw["values"], raw["counts"]
                flat = np.concatenate([c for _, c in trie.vocabulary()])
                logs = np.log10((counts + trie.weight * trie.unigram(flat[keys % words])) / (flat[keys // words] + trie.weight))
                write_arrays(f"{folder}/pairs-{number}", Level.build(np.asarray(keys), logs, words))
                write_arrays(f"{folder}/raw-{number}", {})
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["file"])

    done = gains.select("file").repartition(min(files, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(write_levels, "file int").count()
    if done != gains.count():
        raise RuntimeError("pair files are missing")
    return trie


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(file, distinct values, counts) from rows sorted by file and value."""
    current, keys, counts = None, [], []
    for batch in batches:
        file, value, n = (batch.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(file) else []
        for begin, until in zip(cuts, [*cuts[1:], len(file)], strict=True) if len(file) else ():
            if current is not None and file[begin] != current:
                yield (int(current), *_count(np.concatenate(keys), np.concatenate(counts)))
                keys, counts = [], []
            current = file[begin]
            part, total = _count(value[begin:until], n[begin:until])
            keys.append(part)
            counts.append(total)
    if current is not None:
        yield (int(current), *_count(np.concatenate(keys), np.concatenate(counts)))


RESULT = "n_tokens long, n_known long, base_score double, score double"


def score(trie: Trie, column: str | Column) -> Column:
    """Struct column `RESULT` of a text column, in log10."""

    def part(plain: pa.Array) -> tuple[np.ndarray, ...]:
        hashes, offsets = token_hashes(plain)
        numbers, counts = trie.numbers(hashes)
        end, ends = trie.numbers(np.array([END_HASH], np.uint64))
        chance = np.log10(trie.unigram(counts))
        before, total = np.concatenate([end, numbers[:-1]]), np.concatenate([ends, counts[:-1]])
        before[offsets[:-1]], total[offsets[:-1]] = end[0], ends[0]
        logs = chance.copy()
        if trie.words:
            logs += np.log10(trie.weight / (total + trie.weight))
            known = np.flatnonzero((before >= 0) & (numbers >= 0))
            found = trie.pairs(before[known] * trie.words + numbers[known])
            logs[known] = np.where(np.isnan(found), logs[known], found)
        return np.diff(offsets), sums(counts > 0, offsets), sums(chance, offsets), sums(logs, offsets)

    def of(texts: pa.Array) -> pa.Array:
        plain = text_or_empty(texts)
        parts = [part(plain[a:b]) for a, b in slices(plain, SLICE)]
        columns = [np.concatenate([np.zeros(0), *(p[i] for p in parts)]) for i in range(4)]
        kinds = [np.int64, np.int64, np.float64, np.float64]
        return pa.StructArray.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return F.arrow_udf(of, RESULT)((F.col(column) if isinstance(column, str) else column).cast("string"))
