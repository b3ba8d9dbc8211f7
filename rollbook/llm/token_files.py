"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned and sorted by key; each task writes one shard: the raw ids of its documents (two or four
bytes each) and behind them where each document starts. The index deals the keys by hash over files of their own. Each is
a minimal perfect hash: level after level, keys that meet no other key in a bit array take their bit, the rest goes on, and
the rank of a key's bit is its slot. A slot stores a fingerprint of the key, the shard, the row in it and the number of
copies, so a key is found, or found missing, in constant time.

Keys of any type are hashed by Spark. Null is a key like any other and sorts first. Documents that share a key lie one after
the other in the order of their text's hash and are all found. Null text is empty. Empty tables give no shards and no
index. Files are moved into place whole, so a repeated task leaves the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rollbook.llm.shared import file_system, new_folder, open_arrays, slices, stored, text_or_empty, write_arrays
from rollbook.llm.tokens import encoder

MAGIC = b"TOKENIDS"
#: Bits per key of a level, and keys of an index file on average.
GAMMA = 2.0
KEYS_PER_FILE = 500_000
LEVELS = 64
MISSING = -1


def _mix(first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
    step = np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64))
    x = first ^ (second * np.uint64(0x9E3779B97F4A7C15) + step)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Slots 0 .. n-1 of n distinct (first, second) hashes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.sizes, self.words, self.ranks = arrays["sizes"], arrays["words"], arrays["ranks"]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    @staticmethod
    def build(first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(first):
                break
            size = max(1, -(-int(GAMMA * len(first)) // 64)) * 64
            place = (_mix(first, second, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size // 64)
            rest = ~alone[place]
            first, second = first[rest], second[rest]
        if len(first):
            raise ValueError("keys with equal hashes")
        every = np.concatenate([np.zeros(0, "<u8"), *words])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(every).astype(np.int64))])
        return {"sizes": np.array(sizes, np.int64), "words": every, "ranks": ranks}

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in may get any slot, or MISSING."""
        out, left = np.full(len(first), MISSING, np.int64), np.arange(len(first))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist(), strict=False)):
            if not len(left):
                break
            place = (_mix(first[left], second[left], level) % np.uint64(size * 64)).astype(np.int64)
            word, bit = start + (place >> 6), (place & 63).astype(np.uint64)
            own = self.words[word]
            hit = (own >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[word] + before)[hit]
            left = left[~hit]
        return out


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("first"), F.xxhash64(F.lit("second"), key).alias("second")


class Shard:
    """A shard file, open for reading by rows."""

    def __init__(self, uri: str):
        files, path = file_system(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        foot = self.file.read_at(40, end - 40)
        if foot[32:] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.width, self.rows, self.tokens, at = np.frombuffer(foot[:32], "<i8").tolist()
        self.starts = np.frombuffer(self.file.read_at(8 * (self.rows + 1), at), "<i8")

    def ids(self, row: int) -> np.ndarray:
        begin, until = self.starts[row : row + 2].tolist()
        data = self.file.read_at((until - begin) * self.width, begin * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    folder: str | None = None,
    shards: int | None = None,
    vocabulary: int = 1 << 16,
    keys_per_file: int = KEYS_PER_FILE,
) -> TokenFiles:
    """Write shards and index of all documents; `shards` defaults to the session's shuffle partitions."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    width = 2 if vocabulary <= 1 << 16 else 4
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    ordered = source.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie", "text")
    hashed = ordered.select("text", *key_hashes(F.col("id")))

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode_with_end
        files, path = file_system(f"{folder}/shard-{number:08d}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        draft, starts, rows, tokens = f"{path}.{TaskContext.get().taskAttemptId()}.draft", [np.zeros(1, np.int64)], 0, 0
        with files.open_output_stream(draft) as out:
            for batch in batches:
                texts = text_or_empty(batch.column(0))
                for begin, until in slices(texts):
                    ids, offsets = encode(texts[begin:until], end_id)
                    if len(ids) and int(ids.max()) >= 1 << 8 * width:
                        raise ValueError("an id does not fit the vocabulary")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    sizes, n = np.diff(offsets), until - begin
                    starts.append(tokens + offsets[1:])
                    columns = [pa.array([number] * n, pa.int32()), pa.array(np.arange(rows, rows + n)), pa.array(sizes)]
                    hashes = [batch.column(i).slice(begin, n) for i in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*hashes, *columns], ["first", "second", "shard", "row", "n_tokens"])
                    rows, tokens = rows + n, tokens + int(offsets[-1])
            out.write(np.concatenate(starts).astype("<i8").tobytes())
            out.write(np.array([width, rows, tokens, tokens * width], "<i8").tobytes() + MAGIC)
        files.move(draft, path)

    schema = "first long, second long, shard int, row long, n_tokens long"
    places = stored(hashed.mapInArrow(write_shard, schema), "places")
    per_shard = places.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = stored(per_shard.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("shard", "base"), "bases")
    extents = places.groupBy("first", "second", "shard").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    count = places.count()
    index_files = max(1, -(-count // keys_per_file))
    result = TokenFiles(folder, width, index_files, bases)
    result._write_index(extents)
    return result


class TokenFiles:
    """Written shards and index."""

    def __init__(self, folder: str, width: int, index_files: int, bases: DataFrame):
        self.folder, self.width, self.index_files, self.bases = folder, width, index_files, bases

    def _dealt(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("file", F.pmod(F.xxhash64(F.lit("file"), "first", "second"), F.lit(self.index_files)).cast("int"))

    def _write_index(self, extents: DataFrame) -> None:
        folder = self.folder

        def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["first", "second", "shard"])
            first, second = (frame[c].to_numpy().view(np.uint64) for c in ("first", "second"))
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            at = np.flatnonzero(new)
            arrays = PerfectHash.build(first[at], second[at])
            slot = PerfectHash(arrays).slots(first[at], second[at])
            order = np.argsort(slot)
            arrays["fingerprints"] = (second[at] >> np.uint64(32)).astype(np.uint32)[order]
            counts = np.diff([*at, len(frame)])[order]
            pick = np.repeat(at[order] - np.cumsum(counts) + counts, counts) + np.arange(len(frame))
            arrays["extents"] = np.concatenate([[0], np.cumsum(counts)])
            for name in ("shard", "row", "copies"):
                arrays[name] = frame[name].to_numpy()[pick]
            write_arrays(f"{folder}/index-{int(key[0]):08d}", arrays)
            return pd.DataFrame({"file": [int(key[0])], "keys": [len(at)]})

        stored(self._dealt(extents).groupBy("file").applyInPandas(build, "file int, keys long"), "index")

    def find(self, keys: DataFrame, key_column: str) -> DataFrame:
        """(key, shard, row, copies) of each distinct key that is in the index, by its files alone."""
        folder = self.folder
        distinct = keys.select(F.col(key_column).alias("key")).distinct()
        dealt = self._dealt(distinct.select("key", *key_hashes(F.col("key")))).repartition("file").select("key", "first", "second", "file")
        kind = distinct.schema["key"].dataType.simpleString()

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict[str, np.ndarray]] = {}
            for batch in batches:
                first, second, file = (batch.column(i).to_numpy() for i in (1, 2, 3))
                first, second = first.view(np.uint64), second.view(np.uint64)
                for number in np.unique(file).tolist():
                    if number not in held:
                        held = {number: open_arrays(f"{folder}/index-{number:08d}")}
                    arrays, own = held[number], np.flatnonzero(file == number)
                    slot = PerfectHash(arrays).slots(first[own], second[own])
                    own, slot = own[slot >= 0], slot[slot >= 0]
                    same = arrays["fingerprints"][slot] == (second[own] >> np.uint64(32)).astype(np.uint32)
                    own, slot = own[same], slot[same]
                    begin, counts = arrays["extents"][slot], np.diff(arrays["extents"])[slot]
                    pick = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    columns = [batch.column(0).take(pa.array(np.repeat(own, counts)))]
                    columns += [pa.array(arrays[name][pick]) for name in ("shard", "row", "copies")]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "shard", "row", "copies"])

        return dealt.mapInArrow(look, f"key {kind}, shard int, row long, copies long")

    def read(self, keys: DataFrame, key_column: str, with_ids: bool = False) -> DataFrame:
        """Documents of the keys, from the shards: key, start, n_tokens, ids_crc32, and the ids (uint32) on request."""
        folder = self.folder
        found = self.find(keys, key_column)
        kind = found.schema["key"].dataType.simpleString()
        schema = f"key {kind}, shard int, start_in_shard long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, opened = None, -1
            for batch in batches:
                out: list[list] = [[] for _ in schema.split(", ")]
                numbers, rows, copies = (batch.column(i).to_pylist() for i in (1, 2, 3))
                at, pending = [], 0
                for n, (number, row, many) in enumerate(zip(numbers, rows, copies, strict=True)):
                    if number != opened:
                        if shard:
                            shard.close()
                        shard, opened = Shard(f"{folder}/shard-{number:08d}"), number
                    for own in range(row, row + many):
                        ids = shard.ids(own).astype("<u4")
                        at.append(n)
                        values = [number, int(shard.starts[own]), len(ids), zlib.crc32(ids.tobytes())]
                        if with_ids:
                            values.append(ids.tobytes())
                            pending += ids.nbytes
                        for column, value in zip(out[1:], values, strict=True):
                            column.append(value)
                        if len(at) >= 10_000 or pending > 32 << 20:
                            yield self_batch(batch, at, out)
                            at, pending, out = [], 0, [[] for _ in schema.split(", ")]
                if at:
                    yield self_batch(batch, at, out)
            if shard:
                shard.close()

        def self_batch(batch: pa.RecordBatch, at: list[int], out: list[list]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array(c, k) for c, k in zip(out[1:], kinds, strict=False)]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

        # rows of a shard are read in order; one shard may be read by several tasks
        placed = stored(found, "found").repartitionByRange("shard", "row").sortWithinPartitions("shard", "row")
        # one row per shard file
        rows = placed.mapInArrow(fetch, schema).join(F.broadcast(self.bases), "shard")
        columns = ["key", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"]
        return rows.select(*columns, *(["ids"] if with_ids else []))
