"""Course documents: parsing, chunking, catalog, ingestion, nearest-neighbour search and chat history.

A document stays one row from text to chunks: lines, lessons and sentences are arrays inside the row, so no text is
shuffled. Only the greedy packing of sentence lengths and the distances are Arrow functions.
"""

from __future__ import annotations

import math

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook import fixed_values as fv
from rollbook.functions.text import as_column, collapse, filled, let, strip
from rollbook.scale import all_set, keyed_join, stored

# a lesson line that may be indented
LESSON_START = r"^\s*" + fv.LESSON_LINE[1:]

# --- parsing -----------------------------------------------------------------------------------


def _captured(line: Column, pattern: str, group: int = 1) -> Column:
    """A captured group, stripped; null when the line does not match."""
    return F.when(line.rlike("(?iU)" + pattern), strip(F.regexp_extract(line, "(?iU)" + pattern, group)))


def parse_courses(docs: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """Adds title, course_link, instructor, lessons and body to each document.

    Line one gives the title ("Course Title: ..." or the whole line, else the file name); lines two to four may hold
    link and instructor; the content starts at line four (five when line four is blank). "Lesson N: title" starts a
    lesson, an optional link line follows. `lessons` is an array of (lesson_number, title, lesson_link, text) without
    empty lessons; content before the first marker is left out; without any lesson `body` holds the whole content.
    """
    def headers(lines: Column) -> Column:
        first = strip(F.get(lines, F.lit(0)))

        def header(pattern: str) -> Column:
            found = F.array_compact(F.transform(F.slice(lines, 2, 3), lambda x: _captured(strip(x), pattern)))
            return F.get(F.reverse(found), F.lit(0))

        blank_fourth = (F.size(lines) > 3) & (strip(F.get(lines, F.lit(3))) == "")
        start = F.when(blank_fourth, 5).otherwise(4)
        empty = F.array().cast("array<string>")
        return F.struct(
            F.when(first == "", filled(name)).otherwise(F.coalesce(_captured(first, fv.COURSE_TITLE_LINE), first)).alias("title"),
            header(fv.COURSE_LINK_LINE).alias("course_link"),
            F.nullif(header(fv.INSTRUCTOR_LINE), F.lit("Unknown")).alias("instructor"),
            F.when(F.size(lines) >= start, F.slice(lines, start, F.size(lines))).otherwise(empty).alias("content"),
        )

    def with_lessons(h: Column) -> Column:
        marks = F.transform(h["content"], lambda x, i: F.when(x.rlike("(?iU)" + LESSON_START), i))
        lessons = let(F.array_compact(marks), lambda starts: _lessons(h["content"], starts))
        body = strip(F.array_join(h["content"], "\n"))
        return F.struct(
            h["title"].alias("title"), h["course_link"].alias("course_link"), h["instructor"].alias("instructor"),
            lessons.alias("lessons"), body.alias("body"),
        )

    # every intermediate value is bound once, so a document is split and scanned once however many lessons it has
    parsed = let(F.split(strip(text), "\n"), lambda lines: let(headers(lines), with_lessons))
    added = ("title", "course_link", "instructor", "lessons")
    body = F.when(F.size("__p.lessons") == 0, F.col("__p.body")).otherwise("")
    return docs.withColumn("__p", parsed).select(
        *[as_column(c) for c in docs.columns if c not in (text, "body", *added)],
        *[F.col(f"__p.{c}").alias(c) for c in added],
        body.alias("body"),
    )


def _lessons(content: Column, starts: Column) -> Column:
    """Lessons between the marker positions, empty ones left out."""

    def lesson(at: Column, i: Column) -> Column:
        head = strip(F.get(content, at))
        link = _captured(strip(F.coalesce(F.get(content, at + 1), F.lit(""))), fv.LESSON_LINK_LINE)
        end = F.coalesce(F.get(starts, i + 1), F.size(content))

        def parts(link: Column) -> Column:
            begin = at + F.when(link.isNotNull(), 2).otherwise(1)
            lines = F.slice(content, begin + 1, F.greatest(end - begin, F.lit(0)))
            return F.struct(
                _captured(head, fv.LESSON_LINE).try_cast("int").alias("lesson_number"),
                _captured(head, fv.LESSON_LINE, 2).alias("title"),
                link.alias("lesson_link"),
                strip(F.array_join(lines, "\n")).alias("text"),
            )

        return let(link, parts)

    return F.filter(F.transform(starts, lesson), lambda x: x["text"] != "")


# --- chunking ----------------------------------------------------------------------------------


def sentences(c: Column | str) -> Column:
    """White space collapsed, then split where a sentence ends and a capital follows; abbreviations do not end one."""
    return F.array_remove(F.split(collapse(filled(c)), "(?U)" + fv.SENTENCE_BREAK), "")


def chunk_spans(lengths: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk over sentence lengths.

    A chunk takes sentences while their joined length stays within `size`, at least one. The next one starts at the
    longest tail of this chunk that fits into `overlap`, but always later than this one did.
    """
    ends = [0, *accumulate(n + 1 for n in lengths)]  # joined length of [i, j) is ends[j] - ends[i] - 1
    start = 0
    while start < len(lengths):
        end = max(bisect_right(ends, ends[start] + size + 1) - 1, start + 1)
        yield start, end
        tail = end
        while overlap > 0 and tail > start and ends[end] - ends[tail - 1] - 1 <= overlap:
            tail -= 1
        start = max(tail, start + 1)


def _spans(size: int, overlap: int):
    """Arrow function: sentence lengths of several texts to (start, end) of each text's chunks. Only numbers reach Python, so a
    batch of long documents is small there."""

    @F.arrow_udf("array<array<struct<start: int, end: int>>>")
    def spans(texts: pa.Array) -> pa.Array:
        inner = texts.flatten()
        lengths = inner.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False))
        found, counts = [], [0]
        for begin, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            found += chunk_spans(lengths[begin:end].tolist(), size, overlap)
            counts.append(len(found))
        pairs = np.array(found, np.int32).reshape(-1, 2)
        struct = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
        per_text = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)
        rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(texts), 0).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), per_text)

    return spans


def _lengths(texts: Column | str) -> Column:
    """Sentence lengths of each text, from the sentences of each."""
    return F.transform(texts, lambda found: F.transform(found, F.length))


def _joined(found: Column, spans: Column) -> Column:
    """The chunks of one text: its sentences between each start and end."""
    return F.transform(spans, lambda x: F.array_join(F.slice(found, x["start"] + 1, x["end"] - x["start"]), " "))


def chunk_text(text: Column | str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Array of chunks of a text."""
    spans = F.get(_spans(size, overlap)(_lengths(F.array(sentences(text)))), F.lit(0))
    return let(F.struct(sentences(text).alias("s"), spans.alias("p")), lambda x: _joined(x["s"], x["p"]))


def numbered_chunks(courses: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """(course_title, lesson_number, chunk_index, content, chunk_id) of parsed courses with unique titles.

    The first chunk of a lesson is introduced by "Lesson N content:"; every chunk of a course's last lesson by
    "Course T Lesson N content:". Courses without lessons give plain chunks of the body. A course is one row until its
    chunks are numbered, so neither texts nor chunks are shuffled.
    """
    no_number = F.lit(None).cast("int")
    parts = F.when(
        F.size("lessons") > 0,
        F.transform("lessons", lambda x: F.struct(x["lesson_number"].alias("number"), x["text"].alias("text"))),
    ).otherwise(F.array(F.struct(no_number.alias("number"), F.col("body").alias("text"))))
    rows = courses.select("title", F.size("lessons").alias("n"), parts.alias("parts"))
    texts = F.transform("parts", lambda x: sentences(x["text"]))
    rows = rows.select("title", "n", F.transform("parts", lambda x: x["number"]).alias("numbers"), texts.alias("texts"))
    rows = rows.select("*", _spans(size, overlap)(_lengths("texts")).alias("spans"))
    rows = rows.select("title", "n", "numbers", F.zip_with("texts", "spans", _joined).alias("packed"))

    def introduced(chunks: Column, at: Column) -> Column:
        number = F.get("numbers", at)
        text = number.cast("string")
        last = F.concat(F.lit("Course "), F.col("title"), F.lit(" Lesson "), text, F.lit(" content: "))
        head = F.concat(F.lit("Lesson "), text, F.lit(" content: "))

        def content(chunk: Column, i: Column) -> Column:
            lead = F.when(F.col("n") == 0, "").when(at == F.col("n") - 1, last).when(i == 0, head).otherwise("")
            return F.struct(number.alias("lesson_number"), F.concat(lead, chunk).alias("content"))

        return F.transform(chunks, content)

    every = F.flatten(F.transform("packed", introduced))
    exploded = rows.select(F.col("title").alias("course_title"), F.posexplode(every).alias("chunk_index", "c"))
    return exploded.select(
        "course_title", "c.lesson_number", "chunk_index", "c.content", chunk_ids("course_title", "chunk_index").alias("chunk_id")
    )


# --- catalog and ingestion ---------------------------------------------------------------------


def chunk_ids(title: Column | str, index: Column | str) -> Column:
    return F.concat(F.replace(as_column(title), F.lit(" "), F.lit("_")), F.lit("_"), as_column(index).cast("string"))


def build_catalog(courses: DataFrame, order_by: str = "_ord") -> DataFrame:
    """One row per title: course_link, instructor, lesson_count, lessons. The first document of a title counts."""
    listed = F.transform(
        "lessons", lambda x: F.struct(x["lesson_number"].alias("lesson_number"), x["title"].alias("lesson_title"),
                                      x["lesson_link"].alias("lesson_link"))
    )
    row = F.struct("course_link", "instructor", F.size("lessons").alias("lesson_count"), listed.alias("lessons"))
    return courses.groupBy("title").agg(F.min_by(row, order_by).alias("r")).select("title", "r.*")


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Number of courses and of lessons."""
    return catalog.agg(F.count(F.lit(1)).alias("total_courses"), F.sum("lesson_count").alias("total_lessons"))


def course_titles(catalog: DataFrame) -> DataFrame:
    return catalog.select("title").orderBy("title")


def new_courses(courses: DataFrame, catalog: DataFrame | None, order_by: str = "_ord") -> DataFrame:
    """Parsed documents whose title the catalog lacks; of several with one title the first. No catalog is a rebuild.

    Known titles go before the documents are grouped, so their texts are not shuffled for it.
    """
    row = F.struct(*[as_column(c) for c in courses.columns])
    fresh = courses if catalog is None else courses.join(catalog.select("title"), "title", "left_anti")
    return fresh.groupBy(F.col("title").alias("__title")).agg(F.min_by(row, order_by).alias("r")).select("r.*")


def ingest(
    courses: DataFrame, catalog: DataFrame | None, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP,
    order_by: str = "_ord",
) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, chunks) to append for the courses that are new."""
    fresh = new_courses(courses, catalog, order_by)
    return build_catalog(fresh, order_by), numbered_chunks(fresh, size, overlap)


def course_link(catalog: DataFrame, title: str) -> DataFrame:
    return catalog.where(F.col("title") == title).select("title", "course_link")


def lesson_link(catalog: DataFrame, title: str, number: int) -> DataFrame:
    """Link of the first lesson with that number."""
    match = F.filter("lessons", lambda x: x["lesson_number"] == number)
    return catalog.where(F.col("title") == title).select("title", F.get(match, F.lit(0))["lesson_link"].alias("lesson_link"))


def lesson_links(catalog: DataFrame) -> DataFrame:
    """All lessons as (title, lesson_number, lesson_link)."""
    return catalog.select("title", F.explode("lessons").alias("x")).select("title", "x.lesson_number", "x.lesson_link")


# --- search ------------------------------------------------------------------------------------

BLOCK_BYTES = 16 << 20  # vectors of one block, as numbers of 64 bits
SMALL_BLOCK = 1024  # vectors that are not cut into more blocks to keep all cores busy
CELLS = 4 << 20  # distances held at a time
SPAN = 32  # scores of which one stands for all while a bound is looked for
PLACES = 12  # distances are rounded to this many places, so that equal vectors tie whatever the order of summation


def _meeting(filters: Sequence[str], used: Sequence[str]) -> Column:
    """What a query and the chunks it accepts have in common: the filters that are used, with their values; null fields are
    left out, so a query's unset filters are."""
    values = [F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(filters) if f in used]
    return F.to_json(F.struct(*values)) if values else F.lit("{}")


def _blocks(rows: DataFrame, sizes: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Rows with the number of their own block, repeated for every block of the other side that they meet."""
    met = keyed_join(rows, sizes, ["__meet"], "inner")
    met = met.withColumn(f"__{own}", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.col(f"__{own}_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col(f"__{other}_blocks") - 1))
    return met.withColumn(f"__{other}", every).drop("__q_blocks", "__c_blocks")


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = fv.TOP_K,
    chunk_id: str = "chunk_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    filters: Sequence[str] = (),
    metric: str = "l2",
    max_dist: float | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, distance): the k nearest chunks per query.

    `filters` are columns of both tables; a query's null filter accepts every chunk. Squared L2 by default, `cosine`
    optional; ties go to the smaller chunk id. Queries and chunks that may meet (equal values of the filters a query
    sets) are dealt into blocks of bounded size; every pair of blocks is one group, scored as a matrix product of 32-bit numbers;
    what that leaves within its error of the k best gets its exact distance, and k candidates per query are passed on. Vectors of either side never reach the driver, and the chunks are scanned once, however
    many queries there are; block sizes come from counts per filter value.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}; l2 or cosine")
    filters = list(filters)
    asked = queries.where(F.col(vector).isNotNull())
    # which filters queries set together: at most 2 ** len(filters) kinds; and how long a vector is
    unset = F.array(*[F.col(f"`{f}`").isNull() for f in filters]).cast("array<boolean>")
    facts = asked.agg(F.collect_set(unset).alias("kinds"), F.max(F.size(vector)).alias("d")).first()
    rows = max(1, BLOCK_BYTES // (8 * max(1, facts["d"] or 1)))
    asked = asked.select(F.col(query_id).alias("query"), F.col(vector).alias("vector"), _meeting(filters, filters).alias("__meet"))
    kinds = [[f for f, off in zip(filters, kind, strict=True) if not off] for kind in facts["kinds"]]
    keys = [F.when(all_set(kind), _meeting(filters, kind)) for kind in kinds]
    meets = F.explode(F.array(*keys).cast("array<string>")).alias("__meet")
    held = chunks.where(F.col(vector).isNotNull())  # without a vector there is no distance
    held = held.select(F.col(chunk_id).alias("chunk"), F.col(vector).alias("vector"), meets).where(F.col("__meet").isNotNull())

    # about four pairs of blocks per core, unless blocks get small, so that an even share reaches every core
    busy = math.ceil((4 * asked.sparkSession.sparkContext.defaultParallelism) ** 0.5)

    def counted(meeting: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        blocks = F.greatest(F.ceil(n / rows), F.least(F.ceil(n / SMALL_BLOCK), F.lit(busy)))
        return meeting.groupBy("__meet").agg(blocks.cast("int").alias(f"__{name}_blocks"))

    # counted without the vectors, and kept, so that they are read once
    sizes = stored(counted(asked.select("__meet"), "q").join(counted(chunks.select(meets), "c"), "__meet"), "block-sizes")
    left = _blocks(asked, sizes, "query", "q", "c").groupBy("__meet", "__q", "__c")
    right = _blocks(held, sizes, "chunk", "c", "q").groupBy("__meet", "__q", "__c")
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(chunk_id, chunks.schema[chunk_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    best = left.cogroup(right).applyInArrow(lambda q, c: _nearest(q, c, k, metric, (query_id, chunk_id)), schema)
    if max_dist is not None:
        best = best.where(F.col("distance") <= max_dist)
    order = Window.partitionBy(query_id).orderBy("distance", chunk_id)
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(query_id, "rank", chunk_id, "distance")


def k_smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k smallest distances with their ids, ties to the smaller id."""
    if d.shape[1] > k:
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        near = d <= limit
        counts = near.sum(axis=1)
        if (counts == k).all():
            picked = np.nonzero(near)[1].reshape(-1, k)
        else:  # somewhere the k-th distance is shared
            picked = np.argsort(~near, axis=1, kind="stable")[:, : int(counts.max())]
        d = np.where(np.take_along_axis(near, picked, 1), np.take_along_axis(d, picked, 1), np.inf)
        ids = np.take_along_axis(ids, picked, 1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    d, ids = np.take_along_axis(d, by_id, 1), np.take_along_axis(ids, by_id, 1)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def _points(rows: pa.Table) -> np.ndarray:
    vectors = rows.column("vector").combine_chunks()
    flat, lengths = vectors.flatten(), pc.min_max(pc.list_value_length(vectors)).as_py()
    if flat.null_count or not lengths["min"] or lengths["min"] != lengths["max"]:
        return np.stack(vectors.to_numpy(zero_copy_only=False)).astype("float64")
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype("float64")


def _distances(points: np.ndarray, block: np.ndarray, metric: str) -> np.ndarray:
    dots = points @ block.T
    if metric == "cosine":
        lengths = np.linalg.norm(points, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :]
        return np.round(1 - dots / np.where(lengths == 0, 1, lengths), PLACES)
    squares = (points**2).sum(axis=1)[:, None] + (block**2).sum(axis=1)[None, :]
    return np.round(np.maximum(squares - 2 * dots, 0), PLACES)


def _scored(points: np.ndarray, block: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """32-bit factors whose product orders the chunks of each query as the metric does, and how far apart two such scores may be
    whose order the distances turn round: twice the largest error of a sum of so many products, and the rounding to `PLACES`."""
    slack = 4 * (points.shape[1] + 8) * 2.0**-24
    if metric == "cosine":
        own, other = np.linalg.norm(points, axis=1, keepdims=True), np.linalg.norm(block, axis=1, keepdims=True)
        return (points / np.where(own == 0, 1, own)).astype("f4"), (-block / np.where(other == 0, 1, other)).astype("f4"), slack
    longest = max(np.linalg.norm(points, axis=1).max(), np.linalg.norm(block, axis=1).max()) or 1.0
    points, block = points / longest, block / longest
    half = (block**2).sum(axis=1, keepdims=True) / 2
    left, right = np.hstack([points, np.ones((len(points), 1))]), np.hstack([-block, half])
    return left.astype("f4"), right.astype("f4"), min(slack + 10.0**-PLACES / longest**2, 1e30)


def _bounds(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that at least k reach, near the k-th smallest: the k-th smallest of the least of every `SPAN` scores."""
    n = scores.shape[1]
    if n // SPAN >= 2 * k:
        scores = scores[:, : n - n % SPAN].reshape(len(scores), SPAN, n // SPAN).min(axis=1)
    if scores.shape[1] <= k:
        return np.full((len(scores), 1), np.inf, scores.dtype)
    return np.partition(scores, k - 1, axis=1)[:, k - 1 : k]


def _pair_distances(points: np.ndarray, block: np.ndarray, rows: np.ndarray, columns: np.ndarray, metric: str) -> np.ndarray:
    """As `_distances`, for some cells only."""
    p, b = points[rows], block[columns]
    dots = np.einsum("ij,ij->i", p, b)
    if metric == "cosine":
        lengths = np.linalg.norm(p, axis=1) * np.linalg.norm(b, axis=1)
        return np.round(1 - dots / np.where(lengths == 0, 1, lengths), PLACES)
    return np.round(np.maximum((p**2).sum(axis=1) + (b**2).sum(axis=1) - 2 * dots, 0), PLACES)


def _nearest(queries: pa.Table, chunks: pa.Table, k: int, metric: str, names: tuple[str, str]) -> pa.Table:
    """The k nearest chunks of a block for each query of a block."""
    if not len(queries) or not len(chunks):
        empty = [queries.column("query").slice(0, 0), chunks.column("chunk").slice(0, 0), pa.array([], pa.float64())]
        return pa.table(empty, names=[*names, "distance"])
    points, block = _points(queries), _points(chunks)
    # places of the chunks in the order of their ids: ties go to the first
    ids, place = chunks.column("chunk").combine_chunks(), np.empty(len(block), np.int64)
    place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(block))
    finite = bool(np.isfinite(points).all() and np.isfinite(block).all())
    left, right, slack = _scored(points, block, metric) if finite else (None, None, 0.0)
    owners, columns, distances = [], [], []
    step = max(1, CELLS // len(block))
    for start in range(0, len(points), step):
        some = points[start : start + step]
        near = None
        if finite:
            scores = left[start : start + step] @ right.T
            near = np.flatnonzero(scores <= _bounds(scores, k) + np.float32(slack))
        if near is not None and len(near) * points.shape[1] <= 2 * CELLS:
            row, column = np.divmod(near, len(block))
            d = _pair_distances(some, block, row, column, metric)
            order = np.lexsort((place[column], d, row))
            row = row[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            found = row[kept], column[order][kept], d[order][kept]
        else:  # many equal distances, or numbers without an order
            found = _densely(some, block, place, k, metric)
        owners.append(found[0] + start)
        columns.append(found[1])
        distances.append(found[2])
    taken = [queries.column("query").take(pa.array(np.concatenate(owners))), ids.take(pa.array(np.concatenate(columns)))]
    return pa.table([*taken, pa.array(np.concatenate(distances))], names=[*names, "distance"])


def _densely(points: np.ndarray, block: np.ndarray, place: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, chunk and distance of the k nearest, from all distances of the block."""
    at = np.argsort(place)
    kept_d, kept_places = np.empty((len(points), 0)), np.empty((len(points), 0), place.dtype)
    step = max(1, CELLS // len(points))
    for start in range(0, len(block), step):
        d = _distances(points, block[start : start + step], metric)
        own = np.broadcast_to(place[start : start + step], d.shape)
        kept_d, kept_places = k_smallest(np.hstack([kept_d, d]), np.hstack([kept_places, own]), k)
    return np.repeat(np.arange(len(points)), kept_d.shape[1]), at[kept_places.ravel()], kept_d.ravel()


def resolve_title(
    catalog: DataFrame, queries: DataFrame, title: str = "title", query_id: str = "query_id", vector: str = "embedding",
    metric: str = "l2", max_dist: float | None = None,
) -> DataFrame:
    """(query_id, title, distance): the single nearest title; anything matches unless `max_dist` is given."""
    found = search(catalog, queries, 1, title, query_id, vector, (), metric, max_dist)
    return found.select(query_id, title, "distance")


def search_messages(
    queries: DataFrame, hits: DataFrame, course: str, lesson: str, resolved: str, query_id: str = "query_id"
) -> DataFrame:
    """What to say for each query without hits: an unknown course, or no content within the filters; '' otherwise."""
    counts = hits.groupBy(query_id).agg(F.count(F.lit(1)).alias("n"))
    name, number = filled(course), as_column(lesson)
    nothing = F.concat(
        F.lit("No relevant content found"),
        F.when(name != "", F.concat(F.lit(" in course '"), name, F.lit("'"))).otherwise(""),
        F.when(number.isNotNull() & (number != 0), F.concat(F.lit(" in lesson "), number.cast("string"))).otherwise(""),
        F.lit("."),
    )
    unknown = F.concat(F.lit("No course found matching '"), name, F.lit("'"))
    message = (
        F.when((name != "") & (filled(resolved) == ""), unknown).when(F.coalesce("n", F.lit(0)) == 0, nothing).otherwise("")
    )
    return queries.join(counts, query_id, "left").select(query_id, message.alias("message"))


def format_hits(
    hits: DataFrame, query_id: str = "query_id", rank: str = "rank", course: str = "course_title",
    lesson: str = "lesson_number", content: str = "content",
) -> DataFrame:
    """(query_id, formatted, sources): "[course - Lesson n]" blocks and source labels in rank order; k rows per query."""
    where = F.concat(
        F.coalesce(as_column(course), F.lit("unknown")),
        F.when(as_column(lesson).isNotNull(), F.concat(F.lit(" - Lesson "), as_column(lesson).cast("string"))).otherwise(""),
    )
    block = F.concat(F.lit("["), where, F.lit("]\n"), filled(content))
    entries = F.array_sort(F.collect_list(F.struct(as_column(rank).alias("r"), where.alias("s"), block.alias("b"))))
    return (
        hits.groupBy(query_id)
        .agg(entries.alias("e"))
        .select(
            query_id,
            F.array_join(F.transform("e", lambda x: x["b"]), "\n\n").alias("formatted"),
            F.array_join(F.transform("e", lambda x: x["s"]), ", ").alias("sources"),
        )
    )


# --- history -----------------------------------------------------------------------------------


def session_history(
    messages: DataFrame, n: int = fv.HISTORY_EXCHANGES, session: str = "session_id", turn: str = "turn",
    role: str = "role", content: str = "content",
) -> DataFrame:
    """(session, history): the last 2n messages as "Role: text" lines, oldest first.

    The row limit per session is applied before the shuffle as well, so a long session costs 2n rows per task.
    """
    latest = Window.partitionBy(session).orderBy(F.desc(turn))
    last = messages.withColumn("__at", F.row_number().over(latest)).where(F.col("__at") <= 2 * n)
    line = F.concat(F.initcap(filled(role)), F.lit(": "), filled(content))
    entries = F.array_sort(F.collect_list(F.struct(as_column(turn).alias("t"), line.alias("line"))))
    return last.groupBy(session).agg(F.array_join(F.transform(entries, lambda x: x["line"]), "\n").alias("history"))
