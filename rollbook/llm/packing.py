"""Best-fit decreasing packing of documents into sequences.

Every document's ids plus one end id are cut into full windows; what is left is placed, longest first, into the open
window with the least room that still holds it. A segment tree over the remaining capacities finds that window in
log(capacity) steps. Only piece numbers move: pieces are dealt evenly over groups of `GROUP_PIECES`, packed per group,
and the ids stay with the documents until `sequences` gathers them.

Null text counts as empty, so it has one id, the end id. Repeated rows are documents of their own. A table without rows
gives no pieces. Columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import slices, stored, text_or_empty
from rollbook.llm.tokens import CACHE_WORDS, encoder

CAPACITY = 2048
GROUP_PIECES = 65_536


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.counts = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with room for `least`: (room, window), removed; None if there is none."""
        counts, node = self.counts, least + self.size
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not counts[node]
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += by
            node >>= 1


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; longest first, ties in the given order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, used = OpenWindows(capacity), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[at])
        found = open_windows.take(length) if length < capacity else None
        room, number = found or (capacity, used)
        used += found is None
        window[at], offset[at] = number, capacity - room
        if room > length:
            open_windows.put(room - length, number)
    return window, offset


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """Pieces of at most `capacity` ids: id, start, length, ids_crc32, doc_tokens and, on request, the ids (binary)."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache_words).encode_with_end
        for batch in batches:
            texts = text_or_empty(batch.column(1))
            for begin, until in slices(texts):
                ids, offsets = encode(texts[begin:until], end_id)
                totals = np.diff(offsets)
                counts = -(-totals // capacity)
                row = np.repeat(np.arange(len(totals)), counts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
                length = np.minimum(capacity, totals[row] - start)
                data = memoryview(ids.tobytes())
                spans = [(int(a) * 4, int(a + n) * 4) for a, n in zip(offsets[row] + start, length, strict=True)]
                columns = [
                    batch.column(0).slice(begin, until - begin).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()),
                    pa.array(totals[row]),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(data[a:b]) for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return source.mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each piece (any table with `length`) its sequence_id and offset.

    The pieces are stored first with a number of their own, so a task that runs again meets the same pieces. Groups are
    dealt by the hash of that number: no value of the data can make one group large.
    """
    kept = stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-kept.count() // group_pieces))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        window, offset = best_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=window + (int(key[0]) << 32), offset=offset)

    dealt = kept.groupBy(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))
    return dealt.applyInPandas(place, f"{fields}, sequence_id long, offset long").drop("piece")


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    capacity = options.get("capacity", CAPACITY)
    return pack(pieces(docs, tokenizer, **options), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces packed `with_ids`: sequence_id, n_ids, pieces, ids (little-endian uint32).

    A sequence has at most `capacity` pieces, so its group is bounded; shorter ones are filled up with `pad_id`.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "id", "start", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    used = F.aggregate("parts", F.lit(0).cast("long"), lambda done, part: done + part["length"])
    padding = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({capacity} - n_ids as int)))")
    table = packed.groupBy("sequence_id").agg(parts.alias("parts")).withColumn("n_ids", used)
    spans = F.transform("parts", lambda p: F.struct(p["id"], p["start"], p["length"], p["offset"]))
    return table.select("sequence_id", "n_ids", spans.alias("pieces"), F.concat(joined, padding).alias("ids"))
