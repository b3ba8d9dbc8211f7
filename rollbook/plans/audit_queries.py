"""The audits over the people and board tables, each with the SQL of its main results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.operators import matching
from rollbook.plans import audits, sql
from rollbook.plans import match_queries as mq
from rollbook.plans import report_queries as rq
from rollbook.plans.inputs import board, people

QUERIES = {}
SQL = {}


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


# --- gold against reprocessed ------------------------------------------------------------------


def _slash(source: str) -> str:
    l, f = sql.clean_name("last_name"), sql.clean_name("first_name")
    return (
        "select _ord, unnest(case when l = '' and f = '' then [] when f = '' then [l] when l = '' then [f, g] "
        "else [l || '|' || f, f || '|' || l, l || '|' || g, g || '|' || l] end) as k from "
        f"(select *, split_part(f, ' ', 1) as g from (select _ord, {l} as l, {f} as f from {source}))"
    )


_WHOLE = f"select _ord, {sql.word_list('t')} as w from (select _ord, {sql.clean_name('full_name')} as t from m)"
_GOLD = dict(
    gk=_slash("p"),
    mk=f"{_slash('m')} union all select _ord, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] "
       f"else [w[-1] || '|' || w[1], w[1] || '|' || w[-1]] end) as k from ({_WHOLE})",
    hs="select npi, arg_min(trim(health_system), _ord) as s, arg_min(trim(health_system_city), _ord) as c from m where npi <> '' and trim(health_system) <> '' group by npi",
    g="select p._ord, p.source_tab, case when p.npi <> '' and p.npi in (select npi from m) then 'npi' when p._ord in (select _ord from gk where k in (select k from mk)) then 'name' "
      "else 'not_mailed' end as how from p",
)


def _gold(spark, sf_dir):
    return audits.gold_against_reprocessed(people(spark, sf_dir), board(spark, sf_dir), source="source_tab")


@query("j1_gold_against_reprocessed", sql.with_inputs(
    "p m", "select g._ord, how <> 'not_mailed' as _in_mailed, how as _match_method, case when how = 'npi' then coalesce(hs.s, '') else '' end as _mailed_hs, "
    "case when how = 'npi' then coalesce(hs.c, '') else '' end as _mailed_hs_city from g join p on p._ord = g._ord left join hs on hs.npi = p.npi", **_GOLD))
def _gold_all(spark, sf_dir):
    return _gold(spark, sf_dir)["all"].select("_ord", "_in_mailed", "_match_method", "_mailed_hs", "_mailed_hs_city")


@query("j1_gold_summary", sql.with_inputs(
    "p m", "select source_tab, count(*) as total, count(*) filter (where how <> 'not_mailed') as in_mailed, count(*) filter (where how = 'not_mailed') as not_in_mailed from g group by 1", **_GOLD))
def _gold_summary(spark, sf_dir):
    return _gold(spark, sf_dir)["summary"]


# --- coverage, duplicates, overlap -------------------------------------------------------------

_HOME = ("primary_address_1", "primary_city", "zip5")


def _coverage(spark, sf_dir):
    rows = people(spark, sf_dir)
    tabs = {t: rows.where(F.col("source_tab") == t) for t in ("matched", "npionly", "mnonly", "other")}
    return audits.mailing_coverage(
        tabs, board(spark, sf_dir), "last_name", "first_name", [_HOME, ("mailing_address_1", "mailing_city", "mailing_postal_code")], "full_name", _HOME)


@query("j2_coverage_summary", sql.with_inputs(
    "p m", "select p.source_tab as tab, c.match_method, count(*) as n from (" + mq._coverage_sql("p", "m", "found") + ") c join p on p._ord = c._ord group by all", **mq._COVER))
def _coverage_summary(spark, sf_dir):
    return _coverage(spark, sf_dir)["summary"]


@query("j2_mailing_not_in_providers", sql.with_inputs(
    "p m", "select _ord, match_method from (" + mq._coverage_sql("m", "p", "found") + ") where not found", **mq._COVER))
def _not_covered(spark, sf_dir):
    return _coverage(spark, sf_dir)["mailing_not_in_providers"].select("_ord", "match_method")


@query("j3_check_duplicates", sql.with_inputs(
    "p m", "select _ord, case when _ord in (select _ord from pn where k <> '' and k in (select k from mn)) then 'duplicates' else 'unique' end as list from p",
    pn=mq._COVER["pn"], mn=mq._COVER["mn"]))
def _duplicates(spark, sf_dir):
    found = audits.check_duplicates(
        board(spark, sf_dir), people(spark, sf_dir), matching.roster_names("full_name", None, None), "primary_city",
        matching.roster_names(None, "last_name", "first_name"), "primary_city")
    return found["duplicates"].select("_ord", F.lit("duplicates").alias("list")).unionByName(found["unique"].select("_ord", F.lit("unique").alias("list")))


_PERSON = "{0} || '|' || {1} || '|' || substr({2}, 1, 1)".format(*(sql.norm(c) for c in ("last_name", "first_name", "middle_name")))


@query("j4_addition_not_in_files", sql.with_inputs(
    "p m", f"select _ord, case when {sql.norm('npi')} <> '' and {sql.norm('npi')} in (select {sql.norm('npi')} from p) then 'npi' "
    f"when {_PERSON} <> '||' and {_PERSON} in (select {_PERSON} from p) then 'name' else 'not_found' end as match_method from m"))
def _overlap(spark, sf_dir):
    records = people(spark, sf_dir).withColumn("source", F.concat_ws(" / ", "source_file", "source_tab"))
    return audits.check_overlap(records, board(spark, sf_dir))["addition"].select("_ord", "match_method")


# --- several addresses -------------------------------------------------------------------------


def _several(spark, sf_dir):
    return audits.multiple_addresses(
        board(spark, sf_dir), people(spark, sf_dir), names.fullname_variants("full_name", 3), names.name_variants("last_name", "first_name"),
        [(*rq._A1, None), (*rq._A2, None)], ["_ord", "full_name"], _HOME)


@query("j5_address_status_summary", "select address_status, count(*) as n from (" + rq.SQL["g1_address_status"] + ") group by 1")
def _several_summary(spark, sf_dir):
    return _several(spark, sf_dir)["summary"]


@query("j6_round2_status_summary", "select address_status, _match_method, count(*) as n from (" + rq.SQL["g2_address_status_round2"] + ") group by all")
def _round2_summary(spark, sf_dir):
    found = audits.multiple_addresses_round2(
        board(spark, sf_dir), people(spark, sf_dir), "npi", names.round2_name_keys("first_name", "full_name"), names.name_variants("last_name", "first_name"),
        [(*rq._A1, "primary_state"), (*rq._A2, None)], ["_ord", "full_name"], _HOME)
    return found["method_summary"]


# --- round two, corrections, organisations -----------------------------------------------------

_ISSUES = ("array_to_string(list_filter([case when trim(primary_address_2) = '' and trim(middle_name) = '' then 'missing_address' end, "
           "case when trim(primary_state) = '' then 'missing_state' end, case when trim(zip5) = '' then 'missing_zip' end], lambda x: x is not null), '|')")


def _round2(spark, sf_dir):
    return audits.check_round2(people(spark, sf_dir), ["primary_address_2", "middle_name"], "primary_state", "zip5")


@query("j7_round2_issues", sql.with_inputs("p", f"select _ord, {_ISSUES} as _issues from p where {_ISSUES} <> ''"))
def _issues(spark, sf_dir):
    return _round2(spark, sf_dir)["address_issues"].select("_ord", "_issues")


@query("j7_issue_breakdown", sql.with_inputs("p", f"select flag, count(*) as n from (select unnest(string_split({_ISSUES}, '|')) as flag from p) where flag <> '' group by 1"))
def _issue_breakdown(spark, sf_dir):
    return _round2(spark, sf_dir)["issue_breakdown"]


@query("j8_postal_corrections", "with a as (" + mq.SQL["e11_apply_corrections"] + "), b as (" + mq.SQL["e11_corrections_not_found"] + ") "
       "select 'updated' as \"check\", count(*) as count from a where address_updated = 'Y' union all select 'not_found', count(*) from b")
def _corrected(spark, sf_dir):
    return audits.postal_corrections(people(spark, sf_dir), board(spark, sf_dir), mq._FIX, line2="primary_address_2", silent=("primary_state", "zip5"))["summary"]


# the board's addresses with the organisation that the board has first at each
_SYSTEMS = sql.with_inputs(
    "m", "select x._ord, coalesce(f.hs, '') as health_system, coalesce(f.c, '') as health_system_city from m x left join "
    f"(select {mq._ZA} as k, arg_min({sql.norm('health_system')}, _ord) as hs, arg_min({sql.norm('health_system_city')}, _ord) as c from m "
    f"where {sql.norm('health_system')} <> '' group by 1) f on f.k = {mq._ZA.replace('primary_address_1', 'x.primary_address_1').replace('zip5', 'x.zip5')}")


@query("j9_rank_health_systems",
       f"with l as ({_SYSTEMS}), b as (select health_system, health_system_city as city, count(*) as providers from l where health_system <> '' group by all) "
       "select health_system, cast(sum(providers) as bigint) as total_providers, string_agg(case when city = '' then '(unknown)' else city end || ' (' || providers || ')', ', ' "
       "order by providers desc, city) as cities, row_number() over (order by sum(providers) desc, health_system) as rank from b group by 1")
def _ranked(spark, sf_dir):
    return audits.rank_health_systems(board(spark, sf_dir), board(spark, sf_dir))["ranked"]


def _compared_sql(keys: dict[str, str]) -> str:
    names_, outer = ", ".join(keys), ", ".join(f"coalesce(x.{k}, y.{k}) as {k}" for k in keys)
    other = ", ".join(f"{sql.norm(v)} as {k}" for k, v in keys.items())
    on = " and ".join(f"x.{k} = y.{k}" for k in keys)
    return (
        f"with l as ({_SYSTEMS}), x as (select {names_}, count(*) as n from l where health_system <> '' group by all), "
        f"y as (select {names_}, count(*) as n from (select {other} from supplier join nation on s_nationkey = n_nationkey) where health_system <> '' group by all) "
        f"select {outer}, coalesce(x.n, 0) as round3_providers, coalesce(y.n, 0) as dup_providers, "
        f"case when y.n is null then 'only_in_a' when x.n is null then 'only_in_b' else 'in_both' end as status from x full join y on {on}"
    )


#: Every supplier as a row of the other list, under one of the board's organisations or none.
_SYSTEM = "case s_suppkey % 5 when 0 then 'North Clinic' when 1 then 'LAKE  hospital' when 2 then 'Hill Health' when 3 then '' else 'Clinic of ' || n_name end"
_CITY = "case s_suppkey % 3 when 0 then 'Hudson' when 1 then 'Saint  Cloud' else n_name end"


def _compared(spark, sf_dir):
    from rollbook.plans.inputs import table

    other = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    other = other.selectExpr(f"{_SYSTEM} as System", f"{_CITY} as Clinic_City")
    return audits.compare_health_systems(board(spark, sf_dir), board(spark, sf_dir), other)


@query("j10_compare_systems", _compared_sql({"health_system": _SYSTEM}))
def _compare_systems(spark, sf_dir):
    return _compared(spark, sf_dir)["systems"]


@query("j10_compare_locations", _compared_sql({"health_system": _SYSTEM, "health_system_city": _CITY}))
def _compare_locations(spark, sf_dir):
    return _compared(spark, sf_dir)["locations"]
