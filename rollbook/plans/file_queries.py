"""Sources, sinks and streams: tables derived from the test tables are written, read back and processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.operators import cleaning, matching
from rollbook.plans import course_queries as cq
from rollbook.plans import list_queries as lq
from rollbook.plans import match_queries as mq
from rollbook.plans import sql
from rollbook.plans.inputs import BOARD, COURSES, board, people, table
from rollbook.scale import scratch_path
from rollbook.sources import columns, tables
from rollbook.sources.crosswalk import load_crosswalk
from rollbook.streaming.history import session_history_stream
from rollbook.streaming.ingest import ingest_stream

QUERIES = {}
SQL = {}


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


_TEXTS = [c for c in BOARD if c != "_ord"]


@query("a1_read_delimited", sql.with_inputs("m", f"select cast(_ord as string) as _ord, {', '.join(_TEXTS)} from m"))
def _delimited(spark, sf_dir):
    where = scratch_path(spark, "a1")
    tables.write_tables({"board": board(spark, sf_dir)}, where, format="csv")
    return tables.read_delimited(spark, f"{where}/board")


def people_files(spark, sf_dir, name: str) -> list[str]:
    """One delimited file set per source_file; the second names its ZIP column differently, the third lacks phones."""
    where = scratch_path(spark, name)
    rows = people(spark, sf_dir).withColumnRenamed("_ord", "id")
    parts = {f"file{i}": rows.where(F.col("source_file") == f"file{i}").drop("source_file").sort("id") for i in range(3)}
    parts["file1"] = parts["file1"].withColumnRenamed("zip5", "Zip Code")
    parts["file2"] = parts["file2"].drop("primary_telephone_number")
    tables.write_tables(parts, where, format="csv")
    return [f"{where}/{n}" for n in parts]


_UNION = ("select cast(_ord as string) as id, last_name, first_name, zip5, case when source_file = 'file2' then '' else primary_telephone_number end as primary_telephone_number, "
          "source_file, cast(substr(source_file, 5) as integer) as file_rank from p")


@query("a2_read_union", sql.with_inputs("p", _UNION))
def _union(spark, sf_dir):
    rows = tables.read_union(spark, people_files(spark, sf_dir, "a2"), {"Zip Code": "zip5"})
    return rows.select("id", "last_name", "first_name", "zip5", "primary_telephone_number", "source_file", F.col("_ord.file").alias("file_rank"))


_MERGED = dict(
    k=f"select _ord, source_file, {sql.zip5('zip5')} as z, {lq._NK} as _name_key, count(*) over (partition by {lq._NK}) as _dupe_count from p",
    g="select _name_key, string_agg(distinct source_file, ', ' order by source_file) as files, row_number() over (order by _name_key) as _dupe_group from k where _dupe_count > 1 group by _name_key")
_MERGE_SQL = (f"select cast(p._ord as string) as id, {sql.title('p.last_name')} as last_name, k._dupe_count, coalesce(g._dupe_group, 0) as _dupe_group, coalesce(g.files, '') as _files_in_group, "
              "case when exists (select 1 from k o where o._name_key = k._name_key and o.source_file <> k.source_file and o.z = k.z and k.z <> '') then 'Y' else 'N' end as _zip_match "
              "from p join k on k._ord = p._ord left join g on g._name_key = k._name_key")
_MERGE_COLUMNS = ["id", "last_name", "_dupe_count", "_dupe_group", "_files_in_group", "_zip_match"]


@query("c5_merge_main", sql.with_inputs("p", _MERGE_SQL, **_MERGED))
def _merge_main(spark, sf_dir):
    main, _ = cleaning.merge(spark, people_files(spark, sf_dir, "c5"), {"Zip Code": "zip5"})
    return main.select(*_MERGE_COLUMNS)


@query("c5_merge_review", sql.with_inputs("p", f"select * replace (trim(p2.last_name) as last_name) from (select x.* exclude (last_name), p.last_name from ({_MERGE_SQL}) x join p on cast(p._ord as string) = x.id) p2 where _dupe_count > 1", **_MERGED))
def _merge_review(spark, sf_dir):
    _, review = cleaning.merge(spark, people_files(spark, sf_dir, "c5"), {"Zip Code": "zip5"})
    return review.select(*_MERGE_COLUMNS).withColumn("last_name", F.trim("last_name"))


def _tabs(spark, sf_dir, name: str) -> str:
    where = scratch_path(spark, name)
    rows = people(spark, sf_dir)
    tables.write_tables({t: rows.where(F.col("source_tab") == t) for t in ("matched", "npionly", "mnonly", "other", "none")}, where)
    return where


@query("a3_read_tables", sql.with_inputs(
    "p", "select last_name, npi, source_tab as _source_tab, cast(case source_tab when 'matched' then 0 else 1 end as integer) as tab_rank from p where source_tab in ('matched', 'npionly')"))
def _tables(spark, sf_dir):
    rows = tables.read_tables(spark, _tabs(spark, sf_dir, "a3"), allow=["MATCHED ", "npionly"])
    return rows.select("last_name", "npi", "_source_tab", F.col("_ord.file").alias("tab_rank"))


@query("a4_resolve_roles", sql.with_inputs(
    "m", "select _ord, last_name as last, first_name as first, zip5 as zip, primary_city as city, primary_address_1 as addr from m"))
def _roles(spark, sf_dir):
    rows = board(spark, sf_dir).withColumnsRenamed(
        {"last_name": "LNAME", "first_name": "First Name", "zip5": "Zip Code", "primary_city": "CITY", "primary_address_1": "address_1"})
    found = columns.resolve_roles(rows, fv.ROSTER_ROLES)
    numbered = columns.numbered_address_sets(rows)
    return rows.select("_ord", *[F.col(f"`{c}`").alias(r) for r, c in found.items()], F.col(numbered[0][0]).alias("addr"))


_WRITTEN = ("last_name", "first_name", "npi", "primary_address_1", "primary_address_2", "primary_city", "taxonomy_descriptions", "zip5")


@query("a5_write_tables", sql.with_inputs("p", f"select source_tab as name, {', '.join(_WRITTEN)} from p"))
def _write(spark, sf_dir):
    where = _tabs(spark, sf_dir, "a5")
    return tables.read_tables(spark, where).select(F.col("_source_tab").alias("name"), *_WRITTEN)


@query("a6_read_documents", "select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by 1")
def _documents(spark, sf_dir):
    where = scratch_path(spark, "a6")
    table(spark, sf_dir, "documents").select("text").write.option("maxRecordsPerFile", 100).text(where)
    docs = tables.read_documents(spark, where)
    lines = docs.select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("a7_load_crosswalk", f"with xw as ({mq._XW}) {mq._XW1}")
def _crosswalk(spark, sf_dir):
    return load_crosswalk(mq.crosswalk_table(spark, sf_dir))


_PARSED_NAMES = (
    "select _ord, case when comma then trim(split_part(t, ',', 1)) else coalesce(w[-1], '') end as l, "
    "case when comma then coalesce(r[1], '') when len(w) >= 2 then w[1] else '' end as f, "
    "case when comma then array_to_string(r[2:], ' ') when len(w) > 2 then array_to_string(w[2:-2], ' ') else '' end as mid "
    f"from (select *, {sql.word_list('t')} as w, {sql.word_list('case when comma then substr(t, strpos(t, chr(44)) + 1) else chr(32) end')} as r "
    f"from (select _ord, t, contains(t, ',') as comma from (select _ord, {sql.strip_suffix(sql.norm('full_name'))} as t from m)))"
)


@query("a8_supplement", sql.with_inputs(
    "p m", "select last_name, first_name, middle_name, npi, primary_city, '' as _addr1, source_tab as _source_tab from p union all "
    "select n.l, n.f, n.mid, '', '', trim(m.primary_address_1), 'not_in_gold' from n join m on m._ord = n._ord where n.l <> ''", n=_PARSED_NAMES))
def _supplement(spark, sf_dir):
    gold = people(spark, sf_dir).select(
        "last_name", "first_name", "middle_name", "npi", "primary_city", F.lit("").alias("_addr1"), F.col("source_tab").alias("_source_tab"))
    return matching.supplement(gold, board(spark, sf_dir), "full_name", "primary_address_1", "primary_city", "zip5")


# --- streams -----------------------------------------------------------------------------------


def _stream(spark, sf_dir, name: str):
    schema = table(spark, sf_dir, name).schema
    # a pattern, as the table may be one file or a folder of parts
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _ingested(spark, sf_dir) -> tuple[str, str]:
    where = scratch_path(spark, "s1")
    docs = _stream(spark, sf_dir, "documents").selectExpr(*[f"{e} as {n}" for n, e in COURSES.items()])
    paths = f"{where}/catalog", f"{where}/chunks"
    # the first run sees the table once; a second run with its own checkpoint sees it again and must add nothing
    for run in ("first", "second"):
        ingest_stream(docs, *paths, f"{where}/checkpoint-{run}", order_by="_ord").awaitTermination()
    return paths


@query("s1_ingest_stream", sql.with_inputs("docs", f"select title, course_link, instructor, lesson_count from ({cq._CATALOG})", **cq._FIRSTS))
def _ingest(spark, sf_dir):
    return spark.read.parquet(_ingested(spark, sf_dir)[0]).drop("lessons")


@query("s1_ingested_chunks", cq.chunks_sql())
def _ingest_chunks(spark, sf_dir):
    return spark.read.parquet(_ingested(spark, sf_dir)[1]).drop("batch")


@query("s2_session_history_stream", sql.with_inputs("msgs", cq.HISTORY_SQL))
def _history(spark, sf_dir):
    where = scratch_path(spark, "s2")
    rows = _stream(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) as session_id", "turn", "role", "text as content", "timestamp_seconds(1700000000 + conv_id * 1000 + turn * 60) as ts")

    def keep(batch, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/run={number}")

    writer = session_history_stream(rows).writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("session_id").agg(F.max_by("history", "batch").alias("history"))


