"""People, license-board, survey and course tables derived from the test tables.

The derivations are written in SQL that Spark and DuckDB read alike, so that both sides start from the same rows. All
tables are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.scale import dealt


def _pick(selector: str, *values: str) -> str:
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(values[:-1]))
    return f"case {selector} {cases} else {values[-1]} end"


def _quoted(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


# --- people: one per part ----------------------------------------------------------------------

_K = "p_partkey"
_W1 = "split_part(p_name, ' ', 1)"
_W2 = "split_part(p_name, ' ', 2)"
_SYLLABLE = _pick("p_size % 5", *_quoted("son", "berg", "ley", "man", "ton"))
_LAST = (
    f"case when {_K} % 101 = 0 then '' when {_K} % 13 = 0 then 'de la ' || {_W2} "
    f"when {_K} % 11 = 0 then 'O' || chr(39) || {_W2} || '-' || {_W1} when {_K} % 10 = 0 then {_W2} || ' Jr.' "
    f"when {_K} % 3 = 0 then {_W2} else {_W2} || {_SYLLABLE} end"
)
_FIRST = f"case when {_K} % 101 = 0 then '' when {_K} % 5 = 0 then {_W1} || ' Ann' else {_W1} end"
_MIDDLE = _pick(f"{_K} % 4", *_quoted("", "A.", "bea", "C"))
_CITY = _pick("p_size % 6", "'Saint Paul'", "'ST. CLOUD'", "'Fort Ripley'", "'Mount Iron'", "p_brand", "'Hudson'")
_POSTAL = (
    f"case when {_K} % 23 = 0 then '' when {_K} % 2 = 0 then cast(55000 + {_K} % 97 as string) || '-1234' "
    f"else cast(55000 + {_K} % 97 as string) end"
)

PEOPLE = {
    "_ord": _K,
    "last_name": f"case when {_K} % 4 = 0 then upper({_LAST}) else {_LAST} end",
    "first_name": f"case when {_K} % 4 = 1 then upper({_FIRST}) || ' ' else {_FIRST} end",
    "middle_name": _MIDDLE,
    "npi": f"case when {_K} % 7 = 0 then '' when {_K} % 17 = 0 then '12345' "
    f"else cast(1000000000 + {_K} - {_K} % 2 as string) end",
    "credential": _pick("p_size % 8", *_quoted("MD", "D.O.", "PA-C", "CNM", "FNP-BC", "CRNA", "Registered Nurse", "")),
    "status": _pick("p_size % 3", *_quoted("A", "a", "D")),
    "primary_address_1": "cast(p_size * 10 as string) || "
    + _pick(f"{_K} % 4", *_quoted(" North ", " W. ", " ", " "))
    + " || p_type || "
    + _pick(
        "p_size % 4", "' Street'", f"' Avenue, Suite ' || cast({_K} % 3 as string)",
        f"' Blvd #' || cast({_K} % 3 as string)", "' First Road'",
    ),
    "primary_address_2": f"case when {_K} % 6 = 0 then 'Suite 100' when {_K} % 9 = 0 then 'Lakes Clinic' else '' end",
    "primary_city": _CITY,
    "primary_state": f"case when {_K} % 9 = 0 then 'IA' when p_size % 6 = 5 then 'wi' when {_K} % 19 = 0 then '' "
    "else 'MN' end",
    "primary_postal_code": _POSTAL,
    "zip5": f"substr({_POSTAL}, 1, 5)",
    "primary_telephone_number": f"case when {_K} % 8 = 0 then ' 555-1234' "
    f"else '(612) 555-' || lpad(cast({_K} % 10000 as string), 4, '0') end",
    "mailing_address_1": f"'P.O. Box ' || cast({_K} % 50 as string)",
    "mailing_city": _CITY,
    "mailing_postal_code": f"cast(55000 + ({_K} + 3) % 97 as string)",
    "taxonomy_descriptions": _pick(
        "p_size % 4",
        "'Family Medicine; Family Medicine'",
        "'Internal Medicine, Cardiovascular Disease; Internal Medicine'",
        "'(empty)'",
        "' ; Nursing, ' || p_brand || ', Adult'",
    ),
    "source_file": f"'file' || cast({_K} % 3 as string)",
    "source_tab": _pick(f"{_K} % 5", *_quoted("matched", "npionly", "mnonly", "other", "matched")),
}

# --- the license board: one row per customer ---------------------------------------------------

_C = "c_custkey"
_SIZE = f"({_C} * 7 % 50 + 1)"
_LW = _pick(
    f"({_C} + c_nationkey) % 8", *_quoted("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
)
_FW = _pick("c_nationkey % 8", *_quoted("blue", "cold", "hot", "large", "new", "old", "red", "small"))
_CSYL = _pick(f"{_C} % 5", *_quoted("son", "berg", "ley", "man", "ton"))
_CLAST = (
    f"case when {_C} % 97 = 0 then '' when {_C} % 13 = 0 then 'de la ' || {_LW} "
    f"when {_C} % 11 = 0 then 'O' || chr(39) || {_LW} || '-' || {_FW} "
    f"when {_C} % 6 = 0 then {_LW} || ', MD' when {_C} % 3 = 0 then {_LW} else {_LW} || {_CSYL} end"
)
_CFIRST = f"case when {_C} % 97 = 0 then '' when {_C} % 4 = 0 then {_FW} || ' Ann' else {_FW} end"
_CMID = _pick(f"{_C} % 4", *_quoted("a", "", "B.", "Cy"))
_CCITY = _pick(
    f"{_SIZE} % 6", "'St Paul'", "'Saint Cloud'", "'Ft. Ripley'", "'mount  iron'",
    f"'Brand#' || cast({_C} % 25 + 1 as string)", "'HUDSON'",
)

BOARD = {
    "_ord": _C,
    "last_name": f"case when {_C} % 5 = 1 then upper({_CLAST}) else {_CLAST} end",
    "first_name": _CFIRST,
    "middle_name": _CMID,
    "full_name": f"case when {_C} % 97 = 0 then '' when {_C} % 3 = 0 then {_CLAST} || ', ' || {_CFIRST} || ' ' || {_CMID} "
    f"when {_C} % 3 = 1 then {_CFIRST} || ' ' || {_CMID} || '  ' || {_CLAST} "
    f"else {_CFIRST} || ' ' || {_CLAST} || ', MD' end",
    "npi": f"case when {_C} % 6 = 0 then '' else cast(1000000000 + {_C} as string) end",
    "primary_address_1": f"cast({_SIZE} * 10 as string) || "
    + _pick(f"{_C} % 4", *_quoted(" N ", " West ", " ", " "))
    + " || "
    + _pick(f"{_C} % 6", *_quoted("economy", "Large", "MEDIUM", "promo", "small", "standard"))
    + " || "
    + _pick(
        f"{_SIZE} % 4", "' St.'", f"' Ave Ste ' || cast({_C} % 3 as string)",
        f"' Boulevard # ' || cast({_C} % 3 as string)", "' 1st Rd'",
    ),
    "primary_address_2": f"case when {_C} % 7 = 0 then 'Ste 20' when {_C} % 10 = 0 then 'River Medical' else '' end",
    "primary_city": _CCITY,
    "primary_state": f"case when {_C} % 15 = 0 then 'ia' when {_SIZE} % 6 = 5 then 'WI' else 'MN' end",
    "zip5": f"case when {_C} % 31 = 0 then '' else cast(55000 + {_C} % 97 as string) end",
    "license_type_desc": _pick(
        f"{_C} % 7",
        *_quoted("Medical Doctor", "Physician Assistant", "Nurse Midwife", "APRN", "RN", "DO", "Podiatry"),
    ),
    "license_nbr": f"'L' || cast({_C} % 11 as string)",
    "specialty_boards": _pick(f"{_C} % 4", *_quoted("Family Medicine", "(empty)", "", "cardiology")),
    "certification": _pick(f"{_C} % 5", *_quoted("ABFM", "", "(empty)", "Board", "ABIM")),
    "email": f"case when {_C} % 3 = 0 then '' else 'u' || cast({_C} as string) || '@example.org' end",
    "discipined": f"case when {_C} % 20 = 0 then 'y' else 'N' end",
    "source_file": f"'board' || cast({_C} % 2 as string)",
    "health_system": _pick(
        f"{_SIZE} % 7", "''", f"case when {_C} % 3 = 0 then 'North Clinic' else '' end", "'Lake Hospital'",
        f"case when {_C} % 2 = 0 then 'Solo Practice' else 'Hill Health' end", "'Solo Practice'",
        "'Jane Roe, MD'", f"case when {_C} % 2 = 0 then 'mr# 12' else 'nan' end",
    ),
    "health_system_city": f"case when {_SIZE} % 7 in (0, 6) then '' else {_CCITY} end",
    "note": f"case when {_C} % 9 = 0 then 'solo' when {_C} % 14 = 0 then 'Valley Health' "
    f"when {_C} % 21 = 1 then 'Suite 9' when {_C} % 22 = 1 then 'Dr. Roe' else '' end",
}

# --- the survey: one answer sheet per order ----------------------------------------------------

SURVEY = {
    "rid": "cast(o_orderkey as string)",
    "stamp": "cast(cast(o_orderdate as date) as string) || ' ' || lpad(cast(o_orderkey % 24 as string), 2, '0') || ':30'",
    "elig": _pick("o_orderkey % 3", "' Yes'", "case when o_orderstatus = 'F' then 'yes' else 'No' end", "''"),
    "prof": "case when o_orderkey % 29 = 0 then '' else c_mktsegment end",
    "likert": "case o_orderpriority when '1-URGENT' then 'Strongly agree' when '2-HIGH' then 'Agree' "
    "when '3-MEDIUM' then 'Disagree' when '4-NOT SPECIFIED' then 'Not sure' else '' end",
    "conf": _pick("o_custkey % 4", *_quoted("Very confident", "Not confident", "nan", "Maybe")),
    "box1": "case when o_custkey % 7 = 0 then '' when o_custkey % 2 = 0 then 'Checked' else 'Unchecked' end",
    "box2": "case when o_custkey % 7 = 0 then '' when o_custkey % 3 = 0 then '1' else '0' end",
    "box3": "case when o_custkey % 7 = 0 then '' when o_custkey % 5 = 0 then ' yes ' else 'Unchecked' end",
    "county1": _pick("o_custkey % 6", *_quoted("st. louis", " St Louis", "HENNEPIN", "", "nan", "lac  qui parle")),
    "county2": _pick("o_orderkey % 3", *_quoted("Ramsey", "", "big stone")),
    "specify": "case when o_orderkey % 4 = 0 then 'Always ' || o_orderpriority when o_orderkey % 4 = 1 then 'nan' "
    "when o_orderkey % 4 = 2 then '' else 'other ' || o_orderstatus end",
    "note": "'note ' || cast(o_orderkey as string)",
    "complete": _pick("o_orderkey % 5", *_quoted("Complete", "Complete", "Incomplete", "Unverified", "")),
}

# shown column names of the survey, in order
SURVEY_HEADERS = {
    "rid": "Record ID",
    "stamp": "Unnamed: 1",
    "elig": "As part of your practice, do you provide prenatal, delivery or postpartum care?",
    "prof": "What is your profession?",
    "likert": "Clinicians should screen every patient",
    "conf": "How confident are you to talk about tobacco?",
    "box1": "Which tools do you use? (select all that apply) (choice=Paper form)",
    "box2": "Which tools do you use? (select all that apply) (choice=Tablet)",
    "box3": "Which tools do you use? (select all that apply) (choice=Phone)",
    "county1": "What is the county of your practice?",
    "county2": "What is the county of your practice? 2",
    "specify": "Other screening, please specify",
    "note": "Any remarks",
    "complete": "Intake Complete?",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


PEOPLE_SQL = f"select {select_list(PEOPLE)} from part"
BOARD_SQL = f"select {select_list(BOARD)} from customer"
SURVEY_SQL = f"select {select_list(SURVEY)} from orders join customer on o_custkey = c_custkey"

# course documents: a header and two lessons around the text; every second title repeats
COURSE_TEXT = (
    "'Course Title: Course ' || cast(doc_id - doc_id % 2 as string) || chr(10) || "
    "case when doc_id % 5 = 0 then '' else 'Course Link: http://c/' || cast(doc_id as string) end || chr(10) || "
    "'Course Instructor: ' || case when doc_id % 7 = 0 then 'Unknown' else source end || chr(10) || chr(10) || "
    "case when doc_id % 11 = 0 then 'intro' || chr(10) || text else "
    "'preface' || chr(10) || 'Lesson 0: Start in ' || lang || chr(10) || "
    "case when doc_id % 3 = 0 then '' else 'Lesson Link: http://l/' || cast(doc_id as string) || chr(10) end || text "
    "|| chr(10) || 'lesson 1:  More' || chr(10) || case when doc_id % 4 = 0 then ' ' else text end end"
)
COURSES = {
    "_ord": "doc_id", "file_name": "'doc' || cast(doc_id as string) || '.txt'", "lang": "lang", "text": COURSE_TEXT,
}
COURSES_SQL = f"select {select_list(COURSES)} from documents"
MESSAGES_SQL = "select cast(conv_id as string) as session_id, turn, role, text as content from conversations"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(dealt(table(spark, sf_dir, "part")), PEOPLE)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(dealt(table(spark, sf_dir, "customer")), BOARD)


def survey_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return _derive(joined, SURVEY)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey under its shown column names."""
    return survey_plain(spark, sf_dir).select(*[F.col(n).alias(h) for n, h in SURVEY_HEADERS.items()])


def course_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(dealt(table(spark, sf_dir, "documents")), COURSES)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) as session_id", "turn", "role", "text as content"
    )
