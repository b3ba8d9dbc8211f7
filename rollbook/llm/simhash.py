"""Near copies by SimHash: fingerprints, a segment-popcount grid join, exact verification, components.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints. The segments form `GROUPS` groups; a pair within distance d
differs in at most d of them, so it agrees on the counts of all segments in some choice of GROUPS - d groups. The grid
has one cell per choice and counts; fingerprints of a cell are held against each other, first by Manhattan distance,
then by the exact Hamming distance.

Only distinct fingerprints meet, so exact copies cost one row. Cells above `CELL_ROWS` are not compared pair by pair: their
fingerprints go to an exact join on the points at most ceil(d / 2) bits away, whose groups are never larger than that
ball. Components are found by alternating large-star and small-star steps on stored edges; nothing is collected.

Null text and text without words have fingerprint zero and link like any other. A null id does not count as smallest; a
component of null ids only has a null id. Repeated rows come back repeated. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import kept, slices, stored, text_or_empty, words_of

SEED = 42
BITS = 64
SEGMENT_BITS = 2
GROUPS = 8
#: Distinct fingerprints of a cell that are compared with each other inside a task.
CELL_ROWS = 2048

EVEN = np.uint64(0x5555555555555555)


def fingerprints(texts: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of texts without nulls."""
    numbers, offsets, distinct = words_of(pc.ascii_lower(texts))
    coded = [w.encode() for w in distinct.to_pylist()]
    out = np.zeros(len(texts), np.uint64)
    h64 = xxhash.xxh64_intdigest
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if begin == end:
            continue
        own = [coded[i] for i in numbers[begin:end].tolist()]
        line = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        last = ends[words - 1 :].tolist() or [len(line)]
        first = [0, *(ends[: max(0, len(own) - words)] + 1).tolist()]
        hashes = np.fromiter((h64(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last))
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 65_536):
            part = hashes[at : at + 65_536]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame, text_column: str = "text", name: str = "fingerprint", words: int = 4) -> DataFrame:
    """All columns of docs and the fingerprint (long) as `name`; a column of that name is replaced."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        kept("simhash", "", object)
        plain = text_or_empty(texts)
        found = [fingerprints(plain[a:b], words) for a, b in slices(plain)]
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())

    return docs.withColumn(name, of(F.col(text_column).cast("string")))


def segment_counts(values: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, two bits each, in one word per fingerprint."""
    return (values & EVEN) + ((values >> np.uint64(1)) & EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two packed vectors of segment counts."""
    total = np.zeros(np.broadcast(a, b).shape, np.int16)
    for at in range(0, BITS, 8):
        x, y = (a >> np.uint64(at)) & np.uint64(255), (b >> np.uint64(at)) & np.uint64(255)
        total += BYTE_DISTANCE[x.astype(np.intp), y.astype(np.intp)]
    return total


def _byte_distances() -> np.ndarray:
    fields = (np.arange(256)[:, None] >> np.arange(0, 8, SEGMENT_BITS)) & 3
    return np.abs(fields[:, None, :] - fields[None, :, :]).sum(2).astype(np.int16)


BYTE_DISTANCE = _byte_distances()


def cells(distinct: DataFrame, bits: int, groups: int = GROUPS) -> DataFrame:
    """One row (cell, fp) per fingerprint and choice of `groups` - `bits` groups of segments."""
    if groups <= bits:
        raise ValueError("more groups than differing bits are needed")
    even = F.lit(int(EVEN)).cast("long")
    fp, beside = F.col("fp"), F.shiftrightunsigned("fp", 1)
    both, either = fp.bitwiseAND(beside).bitwiseAND(even), fp.bitwiseXOR(beside).bitwiseAND(even)
    counts = F.shiftleft(both, 1).bitwiseOR(either)
    edge = [SEGMENT_BITS * (g * (BITS // SEGMENT_BITS) // groups) for g in range(groups + 1)]
    masks = [sum(((1 << (edge[g + 1] - edge[g])) - 1) << edge[g] for g in kept) for kept in combinations(range(groups), groups - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
    return distinct.withColumn("counts", counts).select(F.explode(keys).alias("cell"), "fp")


def _linked(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect the same fingerprints as all pairs of `members` within `bits` do."""
    label = np.arange(len(members))
    counts = segment_counts(members)
    edges = []
    for at in range(len(members)):
        rest = np.arange(at + 1, len(members))
        rest = rest[label[rest] != label[at]]
        near = rest[manhattan(counts[at], counts[rest]) <= bits]
        near = near[np.bitwise_count(members[near] ^ members[at]) <= bits]
        for other in near.tolist():
            if label[other] != label[at]:
                edges.append((at, other))
                label[label == label[other]] = label[at]
    return [(int(members[a].view(np.int64)), int(members[b].view(np.int64))) for a, b in edges]


def _grid_links(distinct: DataFrame, bits: int, groups: int, cell_rows: int) -> DataFrame:
    spread = cells(distinct, bits, groups)
    sizes = stored(spread.groupBy("cell").count().filter("count > 1"), "cells")
    # Both kinds of cell from one join; stored, as no aggregate then keeps the join from splitting a cell that many share.
    shared = stored(spread.join(sizes.hint("merge"), "cell"), "shared")
    small, large = shared.filter(F.col("count") <= cell_rows), shared.filter(F.col("count") > cell_rows)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            twos = offsets[:-1][np.diff(offsets) == 2]
            pairs = np.stack([values[twos], values[twos + 1]], 1)
            pairs = pairs[manhattan(segment_counts(pairs[:, 0]), segment_counts(pairs[:, 1])) <= bits]
            pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= bits].view(np.int64)
            found = [e for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a > 2 for e in _linked(values[a:b], bits)]
            edges = np.concatenate([pairs, np.array(found, np.int64).reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    members = small.groupBy("cell").agg(F.collect_list("fp").alias("members"))
    links = members.select("members").mapInArrow(verify, "a long, b long")
    return links.unionByName(ball_links(large.select("fp").distinct(), bits))


def ball_links(distinct: DataFrame, bits: int) -> DataFrame:
    """Exact links by shared points: fingerprints within `bits` have a point that is near both of them.

    Each fingerprint is sent to every point at most ceil(bits / 2) bits away, so no point gathers more than that many
    fingerprints, however dense they lie; a point links each of them to the smallest one. For odd `bits` the far pairs
    that a point can join are verified.
    """
    radius = -(-bits // 2)
    flips = [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(BITS), n)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    spark = distinct.sparkSession
    table = spark.createDataFrame([(signed,)], "flips array<long>")
    points = distinct.join(F.broadcast(table)).select(F.explode("flips").alias("flip"), "fp")
    points = points.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    met = points.groupBy("point").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    pairs = met.select(F.explode("members").alias("b"), F.array_min("members").alias("a"), "members")
    if bits % 2:
        pairs = met.select(F.explode("members").alias("b"), "members").select("b", F.explode("members").alias("a"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return pairs.filter(F.col("a") < F.col("b")).filter(far).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges stay the same; each round is stored, a hub is only ever
    grouped by aggregates.
    """

    def state(table: DataFrame) -> tuple:
        row = table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        joined = both.join(least, "node")
        kept = joined.filter(F.col("other") > F.col("node")) if large else joined.filter(F.col("other") != F.col("least"))
        out = kept.select(F.col("least").alias("a"), F.col("other").alias("b"))
        if not large:
            out = out.unionByName(least.filter(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b")))
        return out.filter("a <> b").distinct()

    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = state(now)
    for _ in range(rounds):
        forth = now.select(F.col("a").alias("node"), F.col("b").alias("other"))
        back = now.select(F.col("b").alias("node"), F.col("a").alias("other"))
        wide = star(forth.unionByName(back), True)
        now = stored(star(wide.select(F.col("b").alias("node"), F.col("a").alias("other")), False), "edges")
        before, seen = seen, state(now)
        if before == seen:
            roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 4,
    bits: int = 4,
    groups: int = GROUPS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per document: id, fingerprint (long), component_id (smallest id reachable over links)."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = stored(with_fingerprint(narrow, words=words).select("id", F.col("fingerprint").alias("fp")), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = stored(components(_grid_links(classes.select("fp"), bits, groups, cell_rows)), "roots")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(named.join(least, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp").select("id", F.col("fp").alias("fingerprint"), "component_id")


def fingerprint_hex(column: str | Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column) if isinstance(column, str) else column), 16, "0"))
