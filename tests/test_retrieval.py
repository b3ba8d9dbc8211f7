import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.operators import retrieval as ops


def plain_chunks(text: str, size: int, overlap: int) -> list[str]:
    """The stated rule, sentence by sentence: fill up to `size`, go back over at most `overlap`, always move on."""
    flat = " ".join(text.split())
    parts = [s for s in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\!|\?)\s+(?=[A-Z])", flat) if s]
    out, at = [], 0
    while at < len(parts):
        take = 1
        while at + take < len(parts) and len(" ".join(parts[at:at + take + 1])) <= size:
            take += 1
        out.append(" ".join(parts[at:at + take]))
        back = 0
        while overlap and back < take and len(" ".join(parts[at + take - back - 1:at + take])) <= overlap:
            back += 1
        at = max(at + take - back, at + 1)
    return out


def test_chunks_equal_the_plain_rule(spark):
    rng = random.Random(3)
    words = ["Dr. Lee", "went", "home.", "He", "said", "e.g.", "this!", "Why?", "No", "é", "U.S.A.", "\n", "  ", "Mr."]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(40)] + ["", "One. Two. Three.", "A" * 50 + ". B."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for size, overlap in ((60, 20), (800, 100), (30, 0), (1, 500)):
        got = {r["i"]: r["c"] for r in df.select("i", ops.chunk_text("t", size, overlap).alias("c")).collect()}
        assert got == {i: plain_chunks(t, size, overlap) for i, t in enumerate(texts)}


def test_a_short_text_repeats_its_tail():
    assert list(ops.chunk_spans([4, 4, 6], 800, 100)) == [(0, 3), (1, 3), (2, 3)]


DOC = "Course Title: Intro  \nCourse Link: http://c\nCourse Instructor: Ann\n\nskipped\nLesson 0: Start\nLesson Link: http://l0\nText one.\nMore.\n lesson 1: Empty\n\nLesson 2: Last\nThe end."


@pytest.fixture
def docs(spark):
    rows = [
        (0, "a.txt", DOC), (1, "b.txt", "Plain title\nx\ny\nBody only.\nSecond line."), (2, "c.txt", ""),
        (3, "d.txt", "Course Title: Intro\n\n\n\nLesson 5: Other\nOther text."), (4, "e.txt", "T\nCourse Instructor: Unknown\nCourse Link: http://e"),
    ]
    return spark.createDataFrame(rows, "_ord long, file_name string, text string")


def test_parse_courses(docs):
    got = {r["file_name"]: r for r in ops.parse_courses(docs).collect()}
    a = got["a.txt"]
    assert (a["title"], a["course_link"], a["instructor"], a["body"]) == ("Intro", "http://c", "Ann", "")
    assert [tuple(x) for x in a["lessons"]] == [(0, "Start", "http://l0", "Text one.\nMore."), (2, "Last", None, "The end.")]
    assert (got["b.txt"]["title"], got["b.txt"]["body"], got["b.txt"]["lessons"]) == ("Plain title", "Body only.\nSecond line.", [])
    assert (got["c.txt"]["title"], got["c.txt"]["body"]) == ("c.txt", "")
    assert (got["e.txt"]["instructor"], got["e.txt"]["course_link"], got["e.txt"]["body"]) == (None, "http://e", "")


def test_course_chunks_carry_their_context(docs):
    chunks = ops.numbered_chunks(ops.new_courses(ops.parse_courses(docs), None))
    assert rows_of(chunks.where("course_title = 'Intro'"), "chunk_index", "lesson_number", "content", "chunk_id") == [
        (0, 0, "Lesson 0 content: Text one. More.", "Intro_0"), (1, 0, "More.", "Intro_1"),
        (2, 2, "Course Intro Lesson 2 content: The end.", "Intro_2")]
    assert rows_of(chunks.where("course_title = 'Plain title'"), "lesson_number", "content") == [(None, "Body only. Second line."), (None, "Second line.")]


def test_catalog_and_ingest(docs):
    courses = ops.parse_courses(docs)
    catalog = ops.build_catalog(courses)
    assert rows_of(catalog, "title", "lesson_count") == [("Intro", 2), ("Plain title", 0), ("T", 0), ("c.txt", 0)]
    assert tuple(ops.catalog_stats(catalog).first()) == (4, 2)
    assert ops.lesson_link(catalog, "Intro", 0).first()["lesson_link"] == "http://l0"
    assert ops.course_link(catalog, "T").first()["course_link"] == "http://e"
    assert [r[0] for r in ops.course_titles(catalog).collect()] == ["Intro", "Plain title", "T", "c.txt"]
    added, chunks = ops.ingest(courses, catalog.where("title <> 'Intro'"))
    assert rows_of(added, "title") == [("Intro",)] and chunks.select("course_title").distinct().count() == 1


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i:02d}", [float(x) for x in rng.normal(size=4)], i % 3) for i in range(40)]
    rows += [("c90", rows[0][1], 0), ("c91", rows[0][1], 0)]  # equal vectors: ties go to the smaller id
    queries = [(i, rows[i][1], None if i % 2 else 0) for i in range(5)]
    return (spark.createDataFrame(rows, "chunk_id string, embedding array<float>, lesson int").repartition(5),
            spark.createDataFrame(queries, "query_id long, embedding array<float>, lesson int"), rows, queries)


@pytest.mark.parametrize("batched", [False, True])
def test_search_equals_brute_force(vectors, batched, monkeypatch):
    if batched:
        monkeypatch.setattr(ops, "BLOCK_BYTES", 64)
    chunks, queries, rows, asked = vectors
    got = ops.search(chunks, queries, k=4, filters=["lesson"])
    want = []
    for q, v, lesson in asked:
        scored = sorted(
            (round(float(((np.float32(v).astype(float) - np.float32(e).astype(float)) ** 2).sum()), 9), c) for c, e, own in rows if lesson in (None, own))
        want += [(q, i + 1, c) for i, (_, c) in enumerate(scored[:4])]
    assert rows_of(got, "query_id", "rank", "chunk_id") == sorted(want)


def test_search_options(vectors):
    chunks, queries, _, _ = vectors
    assert ops.search(chunks, queries, k=3, max_dist=0.0).where("query_id = 0").count() == 3
    assert ops.search(chunks, queries, k=1, metric="cosine").count() == 5
    assert ops.search(chunks, queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ops.search(chunks, queries, metric="dot")


def test_ten_thousand_queries_scan_the_chunks_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK_BYTES", 1 << 16)
    made = spark.range(400).select(
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("chunk_id"),
        F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double") for i in range(4)]).alias("embedding"))
    made.write.parquet(str(tmp_path / "chunks"))
    asked = spark.range(10_000).select(
        F.col("id").alias("query_id"), F.array(*[F.pmod(F.xxhash64("id", F.lit(9 + i)), F.lit(1000)).cast("double") for i in range(4)]).alias("embedding"))
    found = ops.search(spark.read.parquet(str(tmp_path / "chunks")), asked, k=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan
    # the vectors are read by one scan; block sizes were counted without them
    text = found._jdf.queryExecution().executedPlan().toString()
    assert sum("embedding" in line for line in text.splitlines() if "FileScan" in line) == 1
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in found.collect()}
    assert len(got) == 20_000
    names, points = zip(*[(r.chunk_id, r.embedding) for r in made.collect()])
    points = np.array(points)
    for r in asked.where("query_id % 97 = 0").collect():
        d = ((points - np.array(r.embedding)) ** 2).sum(1)
        want = sorted(zip(d, names))[:2]
        assert [got[r.query_id, n] for n in (1, 2)] == [(c, x) for x, c in want]


def test_null_filters_of_chunks_and_queries(spark):
    chunks = spark.createDataFrame([("a", [1.0], 1, "x"), ("b", [1.0], None, "x"), ("c", [1.0], 1, None), ("d", None, 1, "x")], "chunk_id string, embedding array<double>, n int, s string")
    queries = spark.createDataFrame([(1, [1.0], None, None), (2, [1.0], 1, None), (3, [1.0], 1, "x"), (4, [1.0], None, "x"), (5, [1.0], 2, None), (6, None, 1, "x")],
                                    "query_id int, embedding array<double>, n int, s string")
    found = ops.search(chunks, queries, filters=["n", "s"])
    assert rows_of(found, "query_id", "chunk_id") == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (3, "a"), (4, "a"), (4, "b")]


def test_messages_and_format(spark):
    queries = spark.createDataFrame([(1, "X", None, ""), (2, "Y", 3, "Y full"), (3, "", None, "")], "query_id int, course string, lesson int, resolved string")
    hits = spark.createDataFrame([(3, 2, "B", None, "t2"), (3, 1, "A", 4, "t1")], "query_id int, rank int, course_title string, lesson_number int, content string")
    got = ops.search_messages(queries, hits, "course", "lesson", "resolved")
    assert rows_of(got, "query_id", "message") == [(1, "No course found matching 'X'"), (2, "No relevant content found in course 'Y' in lesson 3."), (3, "")]
    assert ops.format_hits(hits).first()[1:] == ("[A - Lesson 4]\nt1\n\n[B]\nt2", "A - Lesson 4, B")


def test_history_keeps_the_last_messages(spark):
    rows = [("s", t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)] + [("t", 0, "user", "hi")]
    df = spark.createDataFrame(rows, "session_id string, turn long, role string, content string").repartition(4)
    got = ops.session_history(df)
    assert rows_of(got, "session_id", "history") == [("s", "Assistant: m3\nUser: m4\nAssistant: m5\nUser: m6"), ("t", "User: hi")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_equal_sentences_survive(spark):
    got = spark.createDataFrame([("A b. A b. A b.",)], "t string").select(F.size(ops.sentences("t"))).first()[0]
    assert got == 3


def python_inputs(df):
    """Types of what Arrow functions of a plan read."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "ArrowEvalPython":
            udfs = node.udfs()
            found += [udfs.apply(i).children().apply(j).dataType().simpleString() for i in range(udfs.size()) for j in range(udfs.apply(i).children().size())]
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_chunking_sends_lengths_to_python_and_no_text(spark, docs):
    courses = ops.new_courses(ops.parse_courses(docs), None)
    assert python_inputs(ops.numbered_chunks(courses)) == ["array<array<int>>"]
    texts = spark.createDataFrame([(0, "Aé one. Two x.  Three y. Four z."), (1, None), (2, ""), (3, "no break")], "i int, t string")
    chunked = texts.select("i", ops.chunk_text("t", 16, 8).alias("c"))
    assert python_inputs(chunked) == ["array<array<int>>"]
    assert {r.i: r.c for r in chunked.collect()} == {0: ["Aé one. Two x.", "Two x. Three y.", "Three y. Four z.", "Four z."], 1: [], 2: [], 3: ["no break"]}


def block(rng, n, d, name, ids):
    return pa.table({name: pa.array(ids), "vector": pa.array(list(rng.normal(size=(n, d)).astype("f4")))})


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_few_cells_get_an_exact_distance(metric, monkeypatch):
    rng = np.random.default_rng(3)
    queries, chunks = block(rng, 300, 8, "query", range(300)), block(rng, 2000, 8, "chunk", [f"c{i * 7 % 2000:04d}" for i in range(2000)])
    want = ops._distances(ops._points(queries), ops._points(chunks), metric)
    monkeypatch.setattr(ops, "CELLS", 1 << 17)  # queries in several steps
    monkeypatch.setattr(ops, "_distances", None)  # all cells in 64 bits are for equal distances only
    found = ops._nearest(queries, chunks, 5, metric, ("q", "c")).to_pylist()
    ids = chunks.column("chunk").to_pylist()
    for q in range(300):
        nearest = sorted(zip(want[q], ids))[:5]
        got = [(r["distance"], r["c"]) for r in found if r["q"] == q]
        assert [c for _, c in got] == [c for _, c in nearest]
        assert np.allclose([d for d, _ in got], [d for d, _ in nearest], atol=1e-11, rtol=0)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scale", [2.0**-30, 1.0, 2.0**40])  # products stay exact
@pytest.mark.parametrize("cells", [64, 4 << 20])
def test_copies_tie_to_the_smaller_id_at_any_scale(metric, scale, cells, monkeypatch):
    monkeypatch.setattr(ops, "CELLS", cells)
    rng = np.random.default_rng(4)
    some = np.vstack([np.repeat(rng.integers(-3, 4, size=(3, 4)), 200, axis=0), np.zeros((5, 4)), rng.integers(-3, 4, size=(200, 4))]) * scale
    ids = rng.permutation(len(some))
    chunks = pa.table({"chunk": pa.array(ids), "vector": pa.array(list(some))})
    asked = pa.table({"query": pa.array(range(20)), "vector": pa.array(list(some[::40][:20]))})
    d = ops._distances(ops._points(asked), some, metric)
    found = ops._nearest(asked, chunks, 4, metric, ("q", "c")).to_pylist()
    for q in range(20):
        got = sorted((r["distance"], r["c"]) for r in found if r["q"] == q)
        assert [c for _, c in got] == [c for _, c in sorted(zip(d[q], ids))[:4]]


def test_blocks_keep_every_core_busy(spark, monkeypatch):
    monkeypatch.setattr(ops, "SMALL_BLOCK", 10)
    held = spark.range(400).select(F.col("id").alias("chunk_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    seen = []
    monkeypatch.setattr(ops, "stored", lambda df, name: seen.append(df.first()) or df)
    ops.search(held, held.withColumnRenamed("chunk_id", "query_id"))
    assert (seen[0]["__q_blocks"], seen[0]["__c_blocks"]) == (4, 4)  # 16 pairs of blocks for 4 cores
