"""Survey tabulation over all orders with their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.operators import survey as ops
from rollbook.plans import sql
from rollbook.plans.inputs import SURVEY_HEADERS, survey, table

QUERIES = {}
SQL = {}


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


H = SURVEY_HEADERS
GROUP = "case when lower(trim(elig)) = 'yes' then 'eligible' else 'ineligible' end"
GROUPED = {"g": f"select *, {GROUP} as grp from v"}
SINGLE = ("elig", "prof", "likert", "conf", "county1", "county2", "complete")
ORDER = {c: i for i, c in enumerate(H)}
COMPLETE_LABEL = "Complete? [after: Any remarks]"
LABELS = {c: H[c] for c in SINGLE} | {"complete": COMPLETE_LABEL}
BOXES = ("box1", "box2", "box3")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _scale(c: str) -> str:
    options = fv.LIKERT if c == "likert" else fv.CONFIDENCE if c == "conf" else ()
    return "case trim(%s) %s else 99 end" % (c, " ".join(f"when {_text(o)} then {i}" for i, o in enumerate(options))) if options else "99"


def _single_sql(columns, by: str = "", source: str = "g") -> str:
    """SQL of freq_single; `by` is a column to group by as well."""
    lead = f"{by}, " if by else ""
    long = " union all ".join(
        f"select {lead}{ORDER[c]} as question_order, {_text(LABELS[c])} as question, trim({c}) as response, {_scale(c)} as scale from {source}" for c in columns)
    part = f"{lead}question_order, question"
    return (f"select {lead}question, 'Single choice' as type, response, n, {sql.pct('n', f'sum(n) over (partition by {part})')} as pct, "
            f"cast(sum(n) over (partition by {part}) as bigint) as n_answered, question_order, "
            f"cast(row_number() over (partition by {part} order by scale, n desc, response) as integer) as response_order from "
            f"(select {part}, response, scale, count(*) as n from ({long}) where response not in ('', 'nan') group by all)")


def _checkbox_sql(by: str = "", order: int = 6, source: str = "g") -> str:
    lead = f"{by}, " if by else ""
    choices = {"box1": "Paper form", "box2": "Tablet", "box3": "Phone"}
    touched = " or ".join(f"trim({c}) <> ''" for c in BOXES)
    rows = " union all ".join(
        f"select {lead}'Which tools do you use?' as question, 'Select all that apply' as type, '{label}' as response, "
        f"count(*) filter (where {sql.checked(c)}) as n, count(*) filter (where {touched}) as n_answered, {order} as question_order, {i + 1} as response_order "
        f"from {source} {'group by ' + by if by else ''}" for i, (c, label) in enumerate(choices.items()))
    return f"select {lead}question, type, response, n, {sql.pct('n', 'n_answered')} as pct, n_answered, question_order, response_order from ({rows})"


def grouped(spark, sf_dir):
    return ops.with_group(survey(spark, sf_dir), H["elig"])


def classes() -> ops.ColumnClasses:
    """The classification that `classify_columns` finds for this survey."""
    return ops.ColumnClasses(
        checkbox_groups={"Which tools do you use?": [H[c] for c in BOXES]}, free_text=[H["specify"], H["note"]],
        timestamps=[H["stamp"]], system=[H["rid"], H["stamp"]], complete=[H["complete"]], single=[H[c] for c in SINGLE],
        labels={H["complete"]: COMPLETE_LABEL})


@query("f13_freq_single", sql.with_inputs("v", _single_sql(SINGLE), **GROUPED))
def _single(spark, sf_dir):
    df = survey(spark, sf_dir)
    at = {c: i for i, c in enumerate(df.columns)}
    return ops.freq_single(df, [H[c] for c in SINGLE], labels=classes().labels, positions=at)


@query("f14_freq_checkbox", sql.with_inputs("v", _checkbox_sql(order=0), **GROUPED))
def _checkbox(spark, sf_dir):
    return ops.freq_checkbox(survey(spark, sf_dir), classes().checkbox_groups)


_ALL = f"{_single_sql(SINGLE, 'grp')} union all {_checkbox_sql('grp')}"


def _freqs(spark, sf_dir):
    return ops.freq_all(grouped(spark, sf_dir), classes())


@query("f15_freq_all", sql.with_inputs("v", f"select * rename (grp as \"group\") from ({_ALL})", **GROUPED))
def _all(spark, sf_dir):
    return _freqs(spark, sf_dir)


@query("f16_split_eligible", sql.with_inputs("v", "select rid as \"Record ID\", elig as screener from g where grp = 'eligible'", **GROUPED))
def _eligible(spark, sf_dir):
    rows, _ = ops.split_eligible(survey(spark, sf_dir))
    return rows.select(H["rid"], F.col(f"`{H['elig']}`").alias("screener"))


@query("f16_split_ineligible", sql.with_inputs("v", "select rid as \"Record ID\", elig as screener from g where grp <> 'eligible'", **GROUPED))
def _ineligible(spark, sf_dir):
    _, rows = ops.split_eligible(survey(spark, sf_dir))
    return rows.select(H["rid"], F.col(f"`{H['elig']}`").alias("screener"))


_PLAIN = [c for c in H if c not in BOXES]
_FACTS = " union all ".join(
    f"select {i} as position, {_text(H[c])} as question, count(*) as answers, count(distinct trim({c})) as distinct_answers, "
    f"(select count(*) from h{i}) as head, (select count(*) from h{i} where regexp_matches(x, '{fv.TIMESTAMP_TEXT}')) as stamps from v where trim({c}) <> ''"
    for i, c in enumerate(_PLAIN))


@query("f17_column_facts", sql.with_inputs(
    "v", _FACTS, **{f"h{i}": f"select trim({c}) as x from v where trim({c}) <> '' order by cast(rid as bigint) limit 20" for i, c in enumerate(_PLAIN)}))
def _facts(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("_ord", F.col(f"`{H['rid']}`").cast("long"))
    return ops.column_facts(df, [H[c] for c in _PLAIN])


@query("f17_classify_columns", sql.with_inputs(
    "v", " union all ".join(
        f"select {_text(H[c])} as \"column\", '{k}' as class, n as rows from (select count(*) as n from v)" for c, k in (
            ("rid", "system"), ("stamp", "timestamp"), ("elig", "single"), ("prof", "single"), ("likert", "single"), ("conf", "single"), ("box1", "checkbox"),
            ("box2", "checkbox"), ("box3", "checkbox"), ("county1", "single"), ("county2", "single"), ("specify", "free text"), ("note", "free text"),
            ("complete", "complete")))))
def _classes(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("_ord", F.col(f"`{H['rid']}`").cast("long"))
    found = ops.classify_columns(df)
    boxes = {c for g in found.checkbox_groups.values() for c in g}

    def kind(c: str) -> str:
        if c in found.timestamps:
            return "timestamp"
        if c in found.system:
            return "system"
        if c in boxes:
            return "checkbox"
        return "free text" if c in found.free_text else "complete" if c in found.complete else "single"

    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind(c)).alias("class")) for c in df.columns if c != "_ord"])
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(listed).alias("c")).select("c.*", "rows")


_COUNTY = ("select rid, grp, raw, " + sql.title(sql.sub(sql.sub("raw", r"\s+", " "), r"(?i)\bSt\.", "St")) + " as norm from (select rid, grp, coalesce("
           + ", ".join(f"case when lower(trim({c})) not in ('', 'nan') then trim({c}) end" for c in ("county1", "county2")) + ", '') as raw from g) where raw <> ''")
_COUNTIES = {**GROUPED, "c": _COUNTY}


def _county_answers(spark, sf_dir):
    return ops.county_answers(grouped(spark, sf_dir), keep=[F.col(f"`{H['rid']}`").alias("record_id")])


@query("f18_county_answers", sql.with_inputs(
    "v", "select rid as record_id, grp as \"group\", raw as county_raw, norm as county_normalized from c", **_COUNTIES))
def _counties(spark, sf_dir):
    return _county_answers(spark, sf_dir)


_E, _I = "count(*) filter (where grp = 'eligible')", "count(*) filter (where grp = 'ineligible')"


@query("f18_county_table", sql.with_inputs(
    "v", f"select county, e as eligible_n, {sql.pct('e', 'te')} as eligible_pct, i as ineligible_n, {sql.pct('i', 'ti')} as ineligible_pct, e + i as total_n from "
    f"(select norm as county, {_E} as e, {_I} as i from c group by 1 union all select 'TOTAL', {_E}, {_I} from c) join (select {_E} as te, {_I} as ti from c) on true", **_COUNTIES))
def _county_table(spark, sf_dir):
    return ops.county_table(_county_answers(spark, sf_dir))


RULES = [("hennepin", "Hennepin Co"), (r"st\.?\s*louis", "St Louis Co")]


@query("f19_county_summary", sql.with_inputs(
    "v", f"select case when lower(raw) like '%hennepin%' then 'Hennepin Co' when regexp_matches(lower(raw), 'st\\.?\\s*louis') then 'St Louis Co' else norm end as county_clean, "
    f"{_E} as eligible, {_I} as ineligible, count(*) as total from c group by 1", **_COUNTIES))
def _county_summary(spark, sf_dir):
    return ops.county_summary(_county_answers(spark, sf_dir), RULES)


@query("f20_free_text_long", sql.with_inputs(
    "v", "select rid as record_id, grp as \"group\", question, response, '' as recode, case when question like 'Other screening%' and lower(response) like '%always%' then 'Always screens' "
    "else response end as response_clean, question_order from (" + " union all ".join(
        f"select rid, grp, {_text(H[c])} as question, trim({c}) as response, {i} as question_order from g where grp = 'eligible' or {everyone}"
        for i, (c, everyone) in enumerate((("specify", "false"), ("note", "false"), ("county2", "true")))) + ") where lower(response) not in ('nan', '', 'checked', 'unchecked', '0', '1')",
    **GROUPED))
def _free_text(spark, sf_dir):
    return ops.free_text_long(
        grouped(spark, sf_dir), [H["specify"], H["note"], H["county2"]], H["rid"], {"other screening": [("always", "Always screens")]})


@query("f21_submission_times", sql.with_inputs(
    "v", "select rid as record_id, grp as \"group\", strftime(t, '%Y-%m-%d %H:%M') as submitted_at, strftime(t, '%Y-%m-%d') as date, dayname(t) as day_of_week, "
    "cast(hour(t) as integer) as hour from (select *, cast(stamp as timestamp) as t from g)", **GROUPED))
def _times(spark, sf_dir):
    return ops.submission_times(grouped(spark, sf_dir), H["stamp"], H["rid"])


def _event_stream_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.col("event_id").cast("string").alias("rid"), F.col("event_type").alias("group"))
    return ops.submission_times(rows, "stamp", "rid")


QUERIES["f21_submission_range"] = lambda spark, sf_dir: ops.submission_range(_event_stream_times(spark, sf_dir))
SQL["f21_submission_range"] = (
    "select event_type as \"group\", count(*) as submissions, strftime(min(ts), '%Y-%m-%d') as first_date, strftime(max(ts), '%Y-%m-%d') as last_date from events group by 1")


def _sides(spark, sf_dir):
    freqs = _freqs(spark, sf_dir)
    return freqs.where("group = 'eligible'"), freqs.where("group = 'ineligible'")


_FREQ = {**GROUPED, "f": _ALL}


def _side(grp: str, name: str, where: str) -> str:
    return (f"select response, cast(sum(n) as bigint) as {name}_n, {sql.pct('sum(n)', f'(select max(n_answered) from f where {where} and grp = {_text(grp)})')} as {name}_pct "
            f"from f where {where} and grp = {_text(grp)} group by 1")


_PROF = f"question = {_text(H['prof'])}"


@query("f22_side_by_side", sql.with_inputs(
    "v", f"select response, coalesce(eligible_n, 0) as eligible_n, coalesce(eligible_pct, 0) as eligible_pct, coalesce(ineligible_n, 0) as ineligible_n, "
    f"coalesce(ineligible_pct, 0) as ineligible_pct from ({_side('eligible', 'eligible', _PROF)}) full join ({_side('ineligible', 'ineligible', _PROF)}) using (response)", **_FREQ))
def _side_by_side(spark, sf_dir):
    elig, inelig = _sides(spark, sf_dir)
    return ops.side_by_side(elig, inelig, H["prof"])


@query("f23_screener_combined", sql.with_inputs(
    "v", f"select response, cast(sum(n) as bigint) as n, {sql.pct('sum(n)', 'sum(sum(n)) over ()')} as pct from f where question = {_text(H['elig'])} group by 1", **_FREQ))
def _screener(spark, sf_dir):
    elig, inelig = _sides(spark, sf_dir)
    return ops.screener_combined(elig, inelig, fv.SCREENER_PATTERNS[0])


@query("f24_completion_pivot", sql.with_inputs(
    "v", f"select question as form, response, cast(coalesce(sum(n) filter (where grp = 'eligible'), 0) as bigint) as \"Eligible\", cast(coalesce(sum(n) filter (where grp = 'ineligible'), 0) as bigint) "
    f"as \"Ineligible\" from f where question = {_text(COMPLETE_LABEL)} group by 1, 2", **_FREQ))
def _completion(spark, sf_dir):
    elig, inelig = _sides(spark, sf_dir)
    return ops.completion_pivot(elig, inelig)


@query("f29_report_counts", sql.with_inputs(
    "v", "select arg_min(n, response_order) filter (where grp = 'eligible' and question like '%prenatal%' and lower(response) like 'yes%') as n_eligible, "
    "max(n_answered) filter (where grp = 'ineligible') as n_ineligible from f", **_FREQ))
def _report(spark, sf_dir):
    elig, inelig = _sides(spark, sf_dir)
    return ops.report_counts(elig, inelig)


