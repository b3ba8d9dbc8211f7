"""Near copies by exact shingle similarity: documents whose sets of shingles have a Jaccard similarity of `least` or more.

Candidates share a band of min-hashes: of `BANDS` bands of `ROWS` values, two sets of similarity 0.8 share one with a probability
of 0.9999, sets of similarity 0.4 in one pair of fifteen, unrelated ones practically never. Every candidate that becomes a link is
held to its exact similarity.

A cell is a band's value with the documents that have it. Its documents are first held against the one that shares most cells
with others (of copies with scattered edits that is the one closest to all), which costs a row per document. In cells that components
then leave apart, those outside the cell's main component are held against all others, in blocks of bounded size: first by their
min-hashes (two sets of similarity 0.8 agree in a share of `ESTIMATE` in 199 of 200 cases, and most have several cells to meet in),
then, in groups of documents that agreed, by the sets themselves. Either time a block returns only links that connect what no other
link of it connects, fewer than it has documents. So no step makes rows of all pairs of a group, though they are compared within
tasks.

Candidates pass a lower bound of the symmetric difference (the Manhattan distance of bucket counts, more buckets for larger sets)
before their sets meet. Texts are never shuffled: tasks look up which of their rows are wanted (`shared.only`). Equal sets cost one document. Words are lower-cased runs without blanks, as in op6; a text of fewer words
than a shingle is one shingle, texts without words are copies of each other. Ids must be unique and not null. Different shingles
meet only if their 64-bit hashes do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import kept, only, slices, stored, text_or_empty, words_of
from rollbook.llm.simhash import components
from rollbook.scale import keyed_join

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of the smallest sets' counts, and shingles in a bucket of larger ones at most; so few that a byte holds them.
BUCKETS, BUCKET_SIZE = 32, 10
#: Bands of min-hashes, and values in a band.
BANDS, ROWS = 40, 7
#: Documents of a cell that are compared with each other in one step, and the share of equal min-hashes that makes a candidate.
BLOCK = 1024
ESTIMATE = 0.74
#: Shingles that are hashed at a time.
CHUNK = 512


def shingles(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text without nulls."""
    numbers, offsets, distinct = words_of(pc.ascii_lower(texts))
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[numbers]
    for begin, until in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        width = min(words, until - begin)
        if not width:
            yield np.zeros(0, np.uint64)
            continue
        places = until - begin - width + 1
        line = np.full(places, width, np.uint64)
        for at in range(begin, begin + width):
            line = line * ODD + own[at : at + places]
            line ^= line >> np.uint64(29)
        yield np.unique(line * ODD)


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers of the hash functions, and of the values within a band."""
    drawn = np.random.default_rng(1000).integers(0, 1 << 63, BANDS * ROWS + ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    return drawn[: BANDS * ROWS], drawn[BANDS * ROWS :]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `BANDS` x `ROWS` min-hashes per set; empty sets have equal ones."""
    by, _ = _factors()
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    for row, own in enumerate(sets):
        for at in range(0, len(own), CHUNK):
            part = own[at : at + CHUNK, None] * by
            least[row] = np.minimum(least[row], (part >> np.uint64(32)).astype(np.uint32).min(0))
    return least


def bands(signed: np.ndarray) -> np.ndarray:
    """A row of `BANDS` band values per signature."""
    value = (signed.reshape(len(signed), BANDS, ROWS).astype(np.uint64) * _factors()[1]).sum(2, dtype=np.uint64)
    value += np.arange(BANDS, dtype=np.uint64) * ODD
    value ^= value >> np.uint64(31)
    return (value * ODD).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; that of empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bucket_counts(ordered: np.ndarray) -> np.ndarray:
    """How many shingles of a set begin with each value of their leading bits."""
    buckets = max(BUCKETS, 1 << max(0, -(-len(ordered) // BUCKET_SIZE) - 1).bit_length())
    place = ordered >> np.uint64(64 - buckets.bit_length() + 1)
    return np.minimum(np.bincount(place.astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def _folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of fewer buckets, in the last dimension."""
    return counts.reshape(*counts.shape[:-1], buckets, -1).sum(-1, dtype=np.int32)


def _most_apart(sizes: np.ndarray | int, size: int, least: float) -> np.ndarray | float:
    """The largest symmetric difference of two sets of similarity `least`."""
    return (1 - least) / (1 + least) * (sizes + size) + 1e-6


def possible(size: int, counts: bytes, other: int, others: bytes, least: float) -> bool:
    """False where bucket counts show that two sets differ in too many shingles."""
    buckets = min(len(counts), len(others))
    a, b = (_folded(np.frombuffer(c, np.uint8), buckets) for c in (counts, others))
    return bool(np.abs(a - b).sum() <= _most_apart(size, other, least))


MARKS = "key long, n int, counts binary, bands array<long>"


def _marked(texts: DataFrame, words: int) -> DataFrame:
    """id, hash of the set, its size, bucket counts and bands of every document."""

    @F.arrow_udf(MARKS)
    def of(column: pa.Array) -> pa.Array:
        kept("similar", "", object)
        plain = text_or_empty(column)
        keys, sizes, counts, found = [], [], [], [np.zeros((0, BANDS), np.int64)]
        for begin, until in slices(plain):
            sets = list(shingles(plain[begin:until], words))
            keys += [xxhash.xxh64_intdigest(own.tobytes()) for own in sets]
            sizes += map(len, sets)
            counts += [bucket_counts(own).tobytes() for own in sets]
            found.append(bands(signatures(sets)))
        flat = np.concatenate(found).ravel()
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)
        columns = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), lists]
        return pa.StructArray.from_arrays(columns, [f.split()[0] for f in MARKS.split(", ")])

    return texts.select("id", of("text").alias("m")).select("id", "m.*")


def _bounded(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that bucket counts leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [possible(*row, least) for row in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    sides = [marked.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("counts").alias(f"counts_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "counts_a", "n_b", "counts_b")
    return both.mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """id and set of every document."""

    @F.arrow_udf("array<long>")
    def whole(column: pa.Array) -> pa.Array:
        plain = text_or_empty(column)
        found = [s.view(np.int64) for a, b in slices(plain) for s in shingles(plain[a:b], words)]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *found]))

    return texts.select("id", whole("text").alias("set"))


def _mins(texts: DataFrame, words: int) -> DataFrame:
    """id and the lowest bytes of the min-hashes of every document."""

    @F.arrow_udf("binary")
    def lowest(column: pa.Array) -> pa.Array:
        plain = text_or_empty(column)
        found = [row.tobytes() for a, b in slices(plain) for row in signatures(list(shingles(plain[a:b], words))).astype(np.uint8)]
        return pa.array(found, pa.binary())

    return texts.select("id", lowest("text").alias("mins"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of `least` or more."""
    near = stored(pairs, "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
            near = [jaccard(*(v[o[i] : o[i + 1]] for v, o in sets)) >= least - 1e-12 for i in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(_sets(only(texts, "id", wanted), words), "sets")
    sides = [sets.select(F.col("id").alias(s), F.col("set").alias(f"set_{s}")) for s in "ab"]
    return near.join(sides[0], "a").join(sides[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long")


def _stars(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of each document of a cell and the cell's centre: the document that shares most cells with others."""
    shared = F.sum("count").alias("shared")
    weight = cells.groupBy("id").agg(shared)
    centres = cells.join(weight, "id").groupBy("cell").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("centre"))
    pairs = keyed_join(cells.select("cell", "id"), centres, ["cell"], "inner").filter("id <> centre")
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _apart(cells: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Rows (cell, id, root, main, rows, others) of the cells of `least` documents or more that lie in different components, with the
    cell's most frequent component, its number of documents and of those outside that."""
    rows = cells.select("cell", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = stored(rows, "members")
    per_root = rows.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"))
    main = per_root.groupBy("cell").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    main = main.filter((F.col("rows") >= least) & (F.col("most") < F.col("rows"))).select("cell", "main", "rows", (F.col("rows") - F.col("most")).alias("others"))
    return stored(keyed_join(rows, main, ["cell"], "inner"), "apart")


#: ids, components, main components of the cell, min-hashes, and sets if the block has them.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray] | None]


def connected(left: Block, right: Block, least: float) -> list[tuple[int, int]]:
    """Links (smaller id, larger id) from documents outside the main component to those of other components that agree in enough
    min-hashes, of blocks with sets those of similarity `least` or more; without what other links connect already: documents, of
    blocks with sets their components."""
    enough, out, what = int(np.ceil(ESTIMATE * BANDS * ROWS)), [], 0 if left[4] is None else 1
    label = np.unique(np.concatenate([left[what], right[what]]), return_inverse=True)[1]
    own, others = label[: len(left[0])], label[len(left[0]) :]
    for at in np.flatnonzero(left[1] != left[2]).tolist():
        # of two documents outside the main component, the smaller asks
        rest = np.flatnonzero((others != own[at]) & (right[1] != left[1][at]) & ((right[1] == right[2]) | (right[0] > left[0][at])))
        for other in rest[(right[3][rest] == left[3][at]).sum(1) >= enough].tolist():
            if others[other] != own[at] and (left[4] is None or jaccard(left[4][at], right[4][other]) >= least - 1e-12):
                pair = int(left[0][at]), int(right[0][other])
                out.append((min(pair), max(pair)))
                label[label == others[other]] = own[at]
    return out


def _block(table: pa.Table) -> Block:
    mins = np.frombuffer(b"".join(table.column("mins").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    sets = None
    if "set" in table.column_names:
        chunks = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in table.column("set").chunks]
        sets = [values[a:b] for values, offsets in chunks for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return *(table.column(c).to_numpy() for c in ("id", "root", "main")), mins, sets


def _connected(apart: DataFrame, marks: DataFrame, block: int, least: float) -> DataFrame:
    """Pairs (a, b) in different components of a cell, as `connected` finds them by `marks` (id, mins, and set where they are to be exact).

    Cells of up to `block` documents are read as a stream, larger ones as pairs of blocks: a block of those outside the cell's
    main component, and a block of all.
    """
    rows = apart.join(marks, "id")

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        edges = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    def within(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        whole = _block(pa.Table.from_batches(parts))
        return connected(whole, whole, least)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            found, cells = [], batch.column("cell").to_numpy()
            bounds = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for begin, until in zip(bounds[:-1], bounds[1:], strict=True):
                if begin == until:
                    continue
                if parts and cells[begin] != now:
                    found += within(parts)
                    parts = []
                now = cells[begin]
                parts.append(batch.slice(begin, until - begin))
            yield pairs(found)
        if parts:
            yield pairs(within(parts))

    columns = ["cell", "id", "root", "main", *marks.columns[1:]]
    small = rows.filter(F.col("rows") <= block).select(*columns).repartition("cell").sortWithinPartitions("cell")
    sizes = {"q": F.ceil(F.col("others") / block), "c": F.ceil(F.col("rows") / block)}
    large = rows.filter(F.col("rows") > block).withColumns(sizes)
    number = F.xxhash64("id")
    asking = large.filter("root <> main").withColumns({"at": F.pmod(number, F.col("q")), "beside": F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))})
    asked = large.withColumns({"beside": F.pmod(number, F.col("c")), "at": F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))})
    # the two sides come from one table, so their columns need names that are told apart
    asking, asked = (side.select(*[F.col(c).alias(c) for c in ("at", "beside", *columns)]) for side in (asking, asked))
    both = asking.groupBy("cell", "at", "beside").cogroup(asked.groupBy("cell", "at", "beside"))

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pairs(connected(_block(left), _block(right), least) if len(left) and len(right) else [])])

    return small.mapInArrow(stream, "a long, b long").unionByName(both.applyInArrow(across, "a long, b long")).distinct()


def similar_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, least: float = 0.8, candidates: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: id and component_id, the smallest id reachable over pairs of similarity `least` or more.

    Pairs (a, b) of ids found elsewhere may be given as `candidates`; like all others they are held to their exact similarity.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = stored(_marked(texts, words), "marked")
    classes = stored(marked.groupBy("key").agg(F.min("id").alias("id")), "classes")
    spread = only(marked, "id", classes.select("id")).select(F.explode("bands").alias("cell"), "id")
    roots = texts.sparkSession.createDataFrame([], "node long, root long")
    links = tried = None
    if candidates is not None:
        of = marked.select("id", "key").join(classes.withColumnRenamed("id", "class"), "key").select("id", "class")
        ends = candidates.join(of.withColumnsRenamed({"id": "a", "class": "x"}), "a").join(of.withColumnsRenamed({"id": "b", "class": "y"}), "b")
        tried = stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "tried")
        links = stored(_verified(_bounded(tried, marked, least), texts, words, least), "links")
        roots = stored(components(links), "roots")
    sizes = stored(spread.groupBy("cell").count().filter("count > 1"), "sizes")
    # stored as it is joined, so that Spark may split a cell that many share
    cells = stored(spread.join(sizes, "cell"), "cells")
    pairs = _stars(cells)
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    found = stored(_verified(_bounded(stored(pairs, "pairs"), marked, least), texts, words, least), "links")
    links = found if links is None else stored(links.unionByName(found), "all-links")
    roots = stored(components(links), "roots")
    apart = _apart(cells, roots, 3)
    mins = stored(_mins(only(texts, "id", apart.select("id").distinct()), words), "mins")
    agreed = stored(_connected(apart, mins, block, least), "agreed")
    if not agreed.isEmpty():
        groups = stored(components(agreed).select(F.col("root").alias("cell"), F.col("node").alias("id")), "groups")
        sets = stored(_sets(only(texts, "id", groups.select("id")), words), "sets")
        found = stored(_connected(_apart(groups, roots, 2), mins.join(sets, "id"), block, least), "links")
        if not found.isEmpty():
            roots = stored(components(stored(links.unionByName(found), "all-links")), "roots")
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("component_id"))
    return marked.select("id", "key").join(named, "key").select("id", "component_id")
