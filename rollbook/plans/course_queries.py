"""Course documents, search and chat history over the document, embedding and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.operators import retrieval as ops
from rollbook.plans import sql
from rollbook.plans.inputs import course_documents, messages, table
from rollbook.scale import dealt

QUERIES = {}
SQL = {}


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


def courses(spark, sf_dir):
    return ops.parse_courses(course_documents(spark, sf_dir))


def _header(pattern: str) -> str:
    """The last of lines two to four that matches."""
    return ("list_filter(list_transform(lines[2:4], lambda x: nullif(regexp_extract(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), "
            f"'(?i){pattern}', 1), '')), lambda x: x is not null)[-1]")


_TITLE = f"regexp_extract({sql.strip('lines[1]')}, '(?i){fv.COURSE_TITLE_LINE}', 1)"
PARSED = {
    "d": f"select _ord, file_name, lang, string_split({sql.strip('text')}, chr(10)) as lines from docs",
    "h": f"select *, coalesce(nullif({_TITLE}, ''), {sql.strip('lines[1]')}) as title, {_header(fv.COURSE_LINK_LINE)} as course_link, "
         f"nullif({_header(fv.INSTRUCTOR_LINE)}, 'Unknown') as instructor, case when len(lines) > 3 and trim(lines[4]) = '' then 5 else 4 end as start from d",
    "l": "select _ord, i, lines[i] as line from (select *, unnest(generate_series(start, len(lines))) as i from h)",
    "n": f"select *, regexp_matches({sql.strip('line')}, '(?i){fv.LESSON_LINE}') as mark from l",
    "o": f"select *, sum(case when mark then 1 else 0 end) over (partition by _ord order by i) as lesson, coalesce(lag(mark) over (partition by _ord order by i), false) "
         f"and regexp_matches({sql.strip('line')}, '(?i){fv.LESSON_LINK_LINE}') as link from n",
    "lessons": f"select _ord, lesson, cast(regexp_extract(max({sql.strip('line')}) filter (where mark), '(?i){fv.LESSON_LINE}', 1) as integer) as lesson_number, "
               f"trim(regexp_extract(max({sql.strip('line')}) filter (where mark), '(?i){fv.LESSON_LINE}', 2)) as lesson_title, "
               f"regexp_extract(max({sql.strip('line')}) filter (where link), '(?i){fv.LESSON_LINK_LINE}', 1) as lesson_link, "
               + sql.strip("string_agg(line, chr(10) order by i) filter (where not mark and not link)") + " as text from o where lesson > 0 group by _ord, lesson",
    "kept": "select *, row_number() over (partition by _ord order by lesson) - 1 as pos from lessons where text <> ''",
}


@query("h1_parse_courses", sql.with_inputs(
    "docs", "select h.file_name, h.title, h.course_link, h.instructor, cast(pos as integer) as pos, lesson_number, lesson_title, lesson_link, md5(k.text) as text_md5 "
    "from kept k join h on h._ord = k._ord", **PARSED))
def _parse(spark, sf_dir):
    rows = courses(spark, sf_dir).select("file_name", "title", "course_link", "instructor", F.posexplode("lessons").alias("pos", "x"))
    return rows.select("file_name", "title", "course_link", "instructor", "pos", "x.lesson_number", F.col("x.title").alias("lesson_title"),
                       "x.lesson_link", F.md5("x.text").alias("text_md5"))


@query("h1_course_bodies", sql.with_inputs(
    "docs", f"select h.file_name, cast((select count(*) from kept k where k._ord = h._ord) as integer) as lessons, case when h._ord in (select _ord from kept) then md5('') else "
    f"md5({sql.strip('array_to_string(lines[start:], chr(10))')}) end as body_md5 from h", **PARSED))
def _bodies(spark, sf_dir):
    return courses(spark, sf_dir).select("file_name", F.size("lessons").alias("lessons"), F.md5("body").alias("body_md5"))


def chunk_ctes(source: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> dict[str, str]:
    """CTEs that end in chunk(k, i, e, content): chunks of a source (k, text), by recursion over their start sentences.

    A break is marked wherever a sentence end meets a capital, and taken back after an abbreviation.
    """
    word = "[\\p{L}\\p{N}_]"
    flat = f"trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
    marked = f"regexp_replace({flat}, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    kept = f"regexp_replace({marked}, '({word}\\.{word}.|[A-Z][a-z]\\.)' || chr(1), '\\1 ', 'g')"
    return {
        "sent": f"select k, list_filter(string_split({kept}, chr(1)), lambda x: x <> '') as s from {source}",
        "each": "select k, i, length(s[i]) + 1 as n from (select k, s, unnest(generate_series(1, len(s))) as i from sent)",
        "ends": "select k, list_prepend(0, list(total order by i)) as ends from (select k, i, sum(n) over (partition by k order by i) as total from each) group by k",
        "span": f"select k, i, ends, greatest(i + 1, list_max(list_filter(generate_series(0, len(ends) - 1), lambda j: ends[j + 1] <= ends[i + 1] + {size + 1}))) as e "
                "from (select k, ends, unnest(generate_series(0, len(ends) - 2)) as i from ends)",
        "step": f"select k, i, e, greatest(i + 1, coalesce(list_min(list_filter(generate_series(i, e - 1), lambda t: ends[e + 1] - ends[t + 1] - 1 <= {overlap})), e)) as nxt from span",
        "chain": "select k, cast(0 as bigint) as i from ends union all select c.k, st.nxt from chain c join step st on st.k = c.k and st.i = c.i join ends on ends.k = c.k where st.nxt < len(ends.ends) - 1",
        "chunk": "select c.k, c.i, st.e, array_to_string(sent.s[c.i + 1:st.e], ' ') as content from chain c join step st on st.k = c.k and st.i = c.i join sent on sent.k = c.k",
    }


_LESSON_TEXTS = {
    **PARSED,
    "fd": "select title, min(_ord) as _ord from h group by title",
    "texts": "select _ord * 1000 + pos as k, text from kept where _ord in (select _ord from fd) union all "
             f"select _ord * 1000, {sql.strip('array_to_string(lines[start:], chr(10))')} from h where _ord in (select _ord from fd) and _ord not in (select _ord from kept)",
}


_CHUNKS = (
    "select title as course_title, lesson_number, cast(row_number() over (partition by title order by k, i) - 1 as integer) as chunk_index, replace(title, ' ', '_') || '_' || "
    "(row_number() over (partition by title order by k, i) - 1) as chunk_id, case when lesson_number is null then '' when k = last_k then 'Course ' || title || ' Lesson ' || lesson_number || ' content: ' "
    "when i = 0 then 'Lesson ' || lesson_number || ' content: ' else '' end || content as content from (select c.*, h.title, x.lesson_number, max(c.k) over (partition by h.title) as last_k from chunk c "
    "join h on h._ord = c.k // 1000 left join kept x on x._ord = c.k // 1000 and x.pos = c.k % 1000)"
)


def chunks_sql(where: str = "true") -> str:
    """All chunks of the first document of each title, for the titles that `where` takes."""
    found = sql.with_inputs("docs", f"{_CHUNKS} where {where}", **_LESSON_TEXTS, **chunk_ctes("texts"))
    return found.replace("with docs", "with recursive docs", 1)


@query("h2_course_chunks", chunks_sql())
def _chunks(spark, sf_dir):
    return ops.numbered_chunks(ops.new_courses(courses(spark, sf_dir), None))


@query("h2_chunk_text", "with recursive " + ", ".join(
    f"{n} as ({q})" for n, q in {"src": "select doc_id as k, text from documents", **chunk_ctes("src")}.items())
    + " select k as doc_id, cast(row_number() over (partition by k order by i) - 1 as integer) as chunk_index, content from chunk")
def _chunk_text(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(ops.chunk_text("text")).alias("chunk_index", "content"))
    return rows


_SENTENCES = chunk_ctes("src")["sent"]


@query("h2_sentences", "with src as (select doc_id as k, text from documents), sent as (" + _SENTENCES + ") "
       "select k as doc_id, cast(unnest(generate_series(0, len(s) - 1)) as integer) as place, unnest(s) as sentence from sent")
def _sentences(spark, sf_dir):
    found = dealt(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(ops.sentences("text")).alias("place", "sentence"))
    return found


_FIRSTS = {**PARSED, "f": "select title, min(_ord) as _ord from h group by title"}
_CATALOG = ("select h.title, h.course_link, h.instructor, cast(count(k._ord) as integer) as lesson_count, coalesce(string_agg(k.lesson_number || ':' || k.lesson_title || "
            "':' || coalesce(k.lesson_link, ''), ' | ' order by k.pos), '') as lessons from f join h on h._ord = f._ord left join kept k on k._ord = h._ord group by all")


def catalog(spark, sf_dir):
    return ops.build_catalog(courses(spark, sf_dir))


def _shown(df):
    one = F.transform("lessons", lambda x: F.concat(x["lesson_number"].cast("string"), F.lit(":"), x["lesson_title"], F.lit(":"), F.coalesce(x["lesson_link"], F.lit(""))))
    return df.withColumn("lessons", F.array_join(one, " | "))


@query("h3_build_catalog", sql.with_inputs("docs", _CATALOG, **_FIRSTS))
def _catalog(spark, sf_dir):
    return _shown(catalog(spark, sf_dir))


@query("h3_catalog_stats", sql.with_inputs(
    "docs", f"select count(*) as total_courses, cast(sum(lesson_count) as bigint) as total_lessons from ({_CATALOG})", **_FIRSTS))
def _stats(spark, sf_dir):
    return ops.catalog_stats(catalog(spark, sf_dir))


def _ingest(spark, sf_dir):
    docs = course_documents(spark, sf_dir)
    existing = ops.build_catalog(ops.parse_courses(docs.where("lang = 'en'")))
    return ops.ingest(ops.parse_courses(docs), existing)


@query("h4_ingest_catalog", sql.with_inputs(
    "docs", f"select title, course_link, instructor, lesson_count from ({_CATALOG}) where title not in (select title from h where lang = 'en')", **_FIRSTS))
def _ingest_catalog(spark, sf_dir):
    return _ingest(spark, sf_dir)[0].drop("lessons")


@query("h4_ingest_chunk_titles", chunks_sql("title not in (select title from h where lang = 'en')"))
def _ingest_chunks(spark, sf_dir):
    return _ingest(spark, sf_dir)[1]


# --- search ------------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, sf_dir):
    """Every vector, read backwards, asks within its own label; label 0 asks everywhere."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding"), F.nullif("label", F.lit(0)).alias("label"))


_PAIRS = ("select q.vec_id as query_id, c.vec_id as chunk_id, c.label, round(pow(list_distance(cast(list_reverse(q.embedding) as double[]), cast(c.embedding as double[])), 2), 12) as d, "
          "round(1 - list_cosine_similarity(cast(list_reverse(q.embedding) as double[]), cast(c.embedding as double[])), 12) as cd, q.label as ql from embeddings q, embeddings c")


def _top(k: int, where: str, d: str = "d") -> str:
    return (f"select query_id, cast(rank as integer) as rank, chunk_id, round({d}, 6) as distance from (select *, row_number() over (partition by query_id order by {d}, chunk_id) as rank "
            f"from pairs where {where}) where rank <= {k}")


@query("h5_search", f"with pairs as ({_PAIRS}) {_top(5, 'true')}")
def _search(spark, sf_dir):
    hits = ops.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir))
    return hits.withColumn("distance", F.round("distance", 6))


@query("h5_search_filtered", f"with pairs as ({_PAIRS}) {_top(3, 'ql = 0 or label = ql')}")
def _search_filtered(spark, sf_dir):
    hits = ops.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), k=3, filters=["label"])
    return hits.withColumn("distance", F.round("distance", 6))


@query("h5_search_cosine", f"with pairs as ({_PAIRS}) {_top(5, 'true', 'cd')}")
def _search_cosine(spark, sf_dir):
    hits = ops.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), metric="cosine")
    return hits.withColumn("distance", F.round("distance", 6))


_HITS = f"with pairs as ({_PAIRS}), hits as ({_top(3, 'ql = 0 or label = ql')})"


@query("h5_search_messages", f"{_HITS} select vec_id as query_id, case when label in (1, 2) then 'No course found matching ''Course ' || label || '''' when vec_id not in (select query_id from hits where rank = 1 "
       "and distance < 2) then 'No relevant content found in course ''Course ' || label || '''' || case when label <> 0 then ' in lesson ' || label else '' end || '.' else '' end as message from embeddings")
def _messages(spark, sf_dir):
    hits = _search_filtered(spark, sf_dir).where("rank = 1 and distance < 2")
    asked = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.concat(F.lit("Course "), F.col("label").cast("string")).alias("course"), F.col("label").alias("lesson"),
        F.when(F.col("label").isin(1, 2), "").otherwise("known").alias("resolved"))
    return ops.search_messages(asked, hits, "course", "lesson", "resolved")


@query("h6_resolve_title", f"with pairs as ({_PAIRS}) select query_id, 'Course ' || chunk_id as title, round(d, 6) as distance from "
       "(select *, row_number() over (partition by query_id order by d, 'Course ' || chunk_id) as rank from pairs) where rank = 1")
def _resolve(spark, sf_dir):
    titles = vectors(spark, sf_dir).select(F.concat(F.lit("Course "), F.col("chunk_id").cast("string")).alias("title"), "embedding")
    found = ops.resolve_title(titles, vector_queries(spark, sf_dir))
    return found.withColumn("distance", F.round("distance", 6))


@query("h7_lesson_links", sql.with_inputs(
    "docs", "select h.title, k.lesson_number, k.lesson_link from f join h on h._ord = f._ord join kept k on k._ord = h._ord", **_FIRSTS))
def _links(spark, sf_dir):
    return ops.lesson_links(catalog(spark, sf_dir))


@query("h7_point_lookups", sql.with_inputs(
    "docs", "select h.title, h.course_link, (select lesson_link from kept k where k._ord = h._ord and lesson_number = 0) as lesson_link from f join h on h._ord = f._ord where h.title = 'Course 14'", **_FIRSTS))
def _point(spark, sf_dir):
    one = catalog(spark, sf_dir)
    return ops.course_link(one, "Course 14").join(ops.lesson_link(one, "Course 14", 0), "title", "left")


@query("h8_format_hits", f"{_HITS} select query_id, string_agg('[Course ' || c.label || case when c.label % 3 = 0 then '' else ' - Lesson ' || c.label % 3 end || ']' || chr(10) || 'text ' || chunk_id, "
       "chr(10) || chr(10) order by rank) as formatted, string_agg('Course ' || c.label || case when c.label % 3 = 0 then '' else ' - Lesson ' || c.label % 3 end, ', ' order by rank) as sources "
       "from hits join embeddings c on c.vec_id = chunk_id group by query_id")
def _format(spark, sf_dir):
    meta = vectors(spark, sf_dir).select(
        "chunk_id", F.concat(F.lit("Course "), F.col("label").cast("string")).alias("course_title"),
        F.nullif(F.col("label") % 3, F.lit(0)).alias("lesson_number"), F.concat(F.lit("text "), F.col("chunk_id").cast("string")).alias("content"))
    hits = ops.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), k=3, filters=["label"])
    return ops.format_hits(hits.join(meta, "chunk_id"))


HISTORY_SQL = (
    "select session_id, string_agg(upper(role[1:1]) || role[2:] || ': ' || content, chr(10) order by turn) as history from "
    "(select *, row_number() over (partition by session_id order by turn desc) as rn from msgs) where rn <= 4 group by session_id"
)


@query("h9_session_history", sql.with_inputs("msgs", HISTORY_SQL))
def _history(spark, sf_dir):
    return ops.session_history(messages(spark, sf_dir))
