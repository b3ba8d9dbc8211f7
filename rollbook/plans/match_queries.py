"""Matching and enrichment over the people and board tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions import names, text
from rollbook.operators import comparing, labelling, matching
from rollbook.plans import function_queries as fq
from rollbook.plans import sql
from rollbook.plans.inputs import BOARD, PEOPLE, board, people

QUERIES = {}
SQL = {}


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


ROLES = {"last": "last_name", "first": "first_name", "zip": "zip5", "city": "primary_city"}
PC, BC = list(PEOPLE), list(BOARD)


def prefixed(columns: list[str], alias: str, prefix: str = "") -> str:
    return ", ".join(f"{alias}.{c} as {prefix}{c}" for c in columns)


# --- E1 ----------------------------------------------------------------------------------------


def _keys(source: str, strict: bool = True) -> str:
    l, f = sql.norm_name("last_name"), sql.norm_name("first_name")
    z, c = sql.zip5("zip5"), sql.norm_name("primary_city")

    def key(tail: str) -> str:
        usable = f"{l} || {f} <> '' and {tail} <> ''" if strict else f"length({l} || {f} || {tail}) > 0"
        return f"case when {usable} then {l} || '|' || {f} || '|' || {tail} end"

    return f"select *, {key(z)} as kz, {key(c)} as kc from {source}"


_CROSS = dict(
    a=_keys("p"), b=_keys("m"),
    a2="select * from a where kz is null or kz not in (select kz from b where kz is not null)",
    b2="select * from b where kz is null or kz not in (select kz from a where kz is not null)",
)
_MATCHED = (
    f"select {prefixed(PC, 'a')}, {prefixed(BC, 'b', 'ext_')} from a join b on a.kz = b.kz union all "
    f"select {prefixed(PC, 'a')}, {prefixed(BC, 'b', 'ext_')} from a2 a join b2 b on a.kc = b.kc"
)


@query("e1_crossref_matched", sql.with_inputs("p m", _MATCHED, **_CROSS))
def _matched(spark, sf_dir):
    return matching.crossref(people(spark, sf_dir), board(spark, sf_dir), ROLES)[0]


@query("e1_crossref_left_only", sql.with_inputs(
    "p m", "select * exclude (kz, kc) from a2 where kc is null or kc not in (select kc from b2 where kc is not null)", **_CROSS))
def _left_only(spark, sf_dir):
    return matching.crossref(people(spark, sf_dir), board(spark, sf_dir), ROLES)[1]


@query("e1_crossref_right_only", sql.with_inputs(
    "p m", "select * exclude (kz, kc) from b2 where kc is null or kc not in (select kc from a2 where kc is not null)", **_CROSS))
def _right_only(spark, sf_dir):
    return matching.crossref(people(spark, sf_dir), board(spark, sf_dir), ROLES)[2]


@query("e1_crossref_zip_nameless", sql.with_inputs(
    "p m", f"select {prefixed(PC, 'a')}, {prefixed(BC, 'b', 'ext_')} from a join b on a.kz = b.kz",
    a=_keys("p", False), b=_keys("m", False)))
def _nameless(spark, sf_dir):
    return matching.crossref(people(spark, sf_dir), board(spark, sf_dir), ROLES, match_city=False, require_name=False)[0]


# --- E2 ----------------------------------------------------------------------------------------

_NK = f"{sql.norm_name('last_name')} || '|' || {sql.norm_name('first_name')}"
_MK = f"{_NK} || '|' || substr({sql.norm_name('middle_name')}, 1, 1)"
_AK = f"{_NK} || '||' || {sql.norm_addr('primary_address_1', 'basic')} || '|' || {sql.zip5('zip5')}"
_JOINED = ("license_type_desc", "license_nbr", "specialty_boards", "certification")


def joined_sql(column: str, group: str, source: str, order: str = "_ord") -> str:
    """SQL of (group, text): distinct filled values ignoring case, in first-seen order."""
    return (
        f"select {group}, string_agg(v, ' | ' order by o) as {column} from (select {group}, min({order}) as o, arg_min(trim({column}), {order}) as v "
        f"from {source} where trim({column}) <> '' group by {group}, lower(trim({column}))) group by {group}"
    )


# consolidated board rows, as SQL over m
CONSOLIDATED = {
    "mk0": f"select *, {_AK} as ak from m",
    "mg": "select ak, min(_ord) as o, count(*) as n, max(upper(discipined) = 'Y') as yes from mk0 group by ak",
    **{f"mj{i}": joined_sql(c, "ak", "mk0") for i, c in enumerate(_JOINED)},
    "mc": "select "
    + ", ".join(
        f"case when n > 1 then coalesce(mj{_JOINED.index(c)}.{c}, '') else f.{c} end as {c}" if c in _JOINED
        else "case when n > 1 and yes then 'Y' else f.discipined end as discipined" if c == "discipined" else f"f.{c} as {c}"
        for c in BC
    )
    + ", n as _mn_specialty_count from mg join mk0 f on f._ord = mg.o "
    + " ".join(f"left join mj{i} on mj{i}.ak = mg.ak" for i in range(len(_JOINED))),
}
SIX = {
    **CONSOLIDATED,
    "l": f"select *, 'NPI' as _source_type, {_MK} as _match_key, {_NK} as _name_key from p",
    "r": f"select *, 'MN' as _source_type, {_MK} as _match_key, {_NK} as _name_key from mc",
    "mk": "select _match_key, sum(n) as n, sum(m) as m from (select _match_key, count(*) as n, 0 as m from l group by 1 "
    "union all select _match_key, 0, count(*) from r group by 1) group by 1",
    "matched": "select _match_key from mk where n = 1 and m = 1",
    "multi": "select _match_key from mk where m > 1 and n >= 1",
    "shared": "select distinct _name_key from l where _name_key in (select _name_key from r)",
    "done": "select distinct split_part(_match_key, '|', 1) || '|' || split_part(_match_key, '|', 2) as _name_key "
    "from (from matched union all from multi)",
    "maybe": "select _name_key from shared where _name_key not in (select _name_key from done)",
}
SIDES = {
    name: f"select _source_type, _ord, _match_key, _name_key from l where {test} union all "
    f"select _source_type, _ord, _match_key, _name_key from r where {test}"
    for name, test in {
        "matched_1to1": "_match_key in (from matched)",
        "multi_specialty": "_match_key in (from multi)",
        "possible": "_name_key in (from maybe)",
    }.items()
}
SIDES["right_only"] = ("select _source_type, _ord, _match_key, _name_key from r where _name_key not in (from shared) "
                       "and upper(trim(primary_state)) = 'MN'")
SIDES["left_only"] = ("select _source_type, _ord, _match_key, _name_key from l where _name_key not in (from shared) "
                      "and upper(trim(primary_state)) = 'MN'")
SIDES["left_only_oos"] = ("select _source_type, _ord, _match_key, _name_key from l where _name_key not in (from shared) "
                          "and upper(trim(primary_state)) <> 'MN'")


def six(spark, sf_dir):
    """The comparison; the board's texts are joined as in the reference column list."""
    registry = people(spark, sf_dir)
    rows = board(spark, sf_dir).withColumnRenamed("specialty_boards", "specialty boards")
    return comparing.compare(registry, rows)


for _name in SIDES:
    QUERIES[f"e2_compare_{_name}"] = lambda spark, sf_dir, n=_name: six(spark, sf_dir)[n].select(
        "_source_type", "_ord", "_match_key", "_name_key")
    SQL[f"e2_compare_{_name}"] = sql.with_inputs("p m", SIDES[_name], **SIX)

# --- E3 ----------------------------------------------------------------------------------------

_XW = ("select cast(55000 + c_custkey % 97 as string) as zip5, case when c_custkey % 2 = 0 then c_mktsegment || ' county' "
       "else 'st. ' || c_mktsegment end as county_name, cast(27000 + c_custkey % 7 as string) as county_fips from customer")
_XW1 = ("select zip5, county_name, county_fips from (select *, row_number() over (partition by zip5 order by "
        f"length(county_name) desc, county_name, county_fips) as rn from (select zip5, {sql.title('county_name')} as county_name, county_fips from xw)) where rn = 1")


def crosswalk_table(spark, sf_dir):
    from rollbook.plans.inputs import table

    return table(spark, sf_dir, "customer").selectExpr(
        "cast(55000 + c_custkey % 97 as string) as ZIPCODE",
        "case when c_custkey % 2 = 0 then c_mktsegment || ' county' else 'st. ' || c_mktsegment end as `County Name`",
        "cast(27000 + c_custkey % 7 as string) as FIPS",
    ).withColumnRenamed("County Name", "CNTY_NAME")


@query("e3_add_county", sql.with_inputs(
    "p", "select p._ord, p.zip5, coalesce(x.county_name, '') as county_name, coalesce(x.county_fips, '') as county_fips "
    "from p left join x on p.zip5 = x.zip5", xw=_XW, x=_XW1))
def _add_county(spark, sf_dir):
    from rollbook.sources.crosswalk import load_crosswalk

    rows = people(spark, sf_dir).select("_ord", "zip5")
    return matching.add_county(rows, load_crosswalk(crosswalk_table(spark, sf_dir)))


# --- E4, E5, E6 --------------------------------------------------------------------------------


def unnested(source: str, *keep: str) -> str:
    return f"select {', '.join(keep) + ',' if keep else ''} unnest(keys) as k from ({source})"


_GOLD_NAMES = sql.name_variants("p", "last_name", "first_name", True)
_MAIL_NAMES = (
    "select _ord, unnest(case when trim(full_name) <> '' then k1 else k2 end) as k from ("
    + sql.name_variants(
        "(select _ord, last_name, first_name, full_name, k1 from (" + sql.fullname_variants("m", "full_name", 2, True, True, "k1") + "))",
        "last_name", "first_name", True, "k2") + ")"
)


@query("e4_match_cascade", sql.with_inputs(
    "p m", "select p._ord, p.last_name, p.first_name, p.npi, h.by is not null as in_any_mailing, coalesce(h.by, 'not_mailed') as mailing_match "
    "from p left join (select _ord, case when bool_or(kind = 'npi') then 'npi' else 'name' end as by from hits group by _ord) h on h._ord = p._ord",
    gn=unnested(_GOLD_NAMES, "_ord"), mn=_MAIL_NAMES,
    hits=f"select _ord, 'npi' as kind from p where {sql.norm('npi')} <> '' and {sql.norm('npi')} in (select {sql.norm('npi')} from m) "
         "union all select _ord, 'name' from gn where k <> '' and k in (select k from mn)"))
def _cascade(spark, sf_dir):
    gold, mailing = people(spark, sf_dir), board(spark, sf_dir)
    flagged = matching.match_cascade(
        gold.select("_ord", "last_name", "first_name", "npi"), mailing,
        matching.npi_then_name(gold, "npi", "last_name", "first_name"),
        matching.npi_then_name(mailing, "npi", "last_name", "first_name", "full_name"),
        found="in_any_mailing", method="mailing_match", miss="not_mailed")
    return flagged


@query("e4_not_in_gold", sql.with_inputs(
    "p m", "select _ord, npi, full_name from m where not coalesce(npi <> '' and npi in (select npi from p), false) "
    "and _ord not in (select _ord from mn where k <> '' and k in (select k from gn))",
    gn=unnested(_GOLD_NAMES, "_ord"), mn=_MAIL_NAMES))
def _not_in_gold(spark, sf_dir):
    gold, mailing = people(spark, sf_dir), board(spark, sf_dir)
    flagged = matching.match_cascade(
        mailing.select("_ord", "npi", "full_name", "last_name", "first_name"), gold,
        matching.npi_then_name(mailing, "npi", "last_name", "first_name", "full_name"),
        matching.npi_then_name(gold, "npi", "last_name", "first_name"))
    return flagged.where("not in_other").select("_ord", "npi", "full_name")


@query("e4_carry_label", sql.with_inputs(
    "p m", "select p._ord, p.npi, coalesce(f.hs, '') as health_system, coalesce(f.c, '') as health_system_city from p left join "
    "(select npi, arg_min(health_system, _ord) as hs, arg_min(health_system_city, _ord) as c from m where npi <> '' and trim(health_system) <> '' "
    "group by npi) f on f.npi = p.npi"))
def _carry(spark, sf_dir):
    gold, mailing = people(spark, sf_dir).select("_ord", "npi"), board(spark, sf_dir)
    flagged = matching.match_cascade(gold, mailing, {"npi": F.array(text.norm("npi"))}, {"npi": F.array(text.norm("npi"))})
    done = matching.carry_label(flagged, mailing, "npi", "npi", ["health_system", "health_system_city"])
    return done.select("_ord", "npi", "health_system", "health_system_city")


def _addr(a: str, c: str, z: str) -> str:
    return f"case when {sql.norm(a)} = '' then '' else {sql.norm(a)} || '|' || {sql.norm(c)} || '|' || {sql.zip5(z)} end"


_COVER = dict(
    pn=unnested(sql.name_variants("p", "last_name", "first_name"), "_ord"),
    mn=unnested(sql.fullname_variants("m", "full_name", 3), "_ord"),
    pa=f"select _ord, {_addr('primary_address_1', 'primary_city', 'zip5')} as k from p union all "
       f"select _ord, {_addr('mailing_address_1', 'mailing_city', 'mailing_postal_code')} from p",
    ma=f"select _ord, {_addr('primary_address_1', 'primary_city', 'zip5')} as k from m",
)


def _coverage_sql(side: str, other: str, flag: str) -> str:
    return (
        f"select x._ord, coalesce(n.hit, a.hit, false) as {flag}, case when n.hit then 'name' when a.hit then 'address' else 'not_found' end "
        f"as match_method from {side} x left join (select distinct _ord, true as hit from {side}n where k <> '' and k in (select k from {other}n)) n "
        f"on n._ord = x._ord left join (select distinct _ord, true as hit from {side}a where k <> '' and k in (select k from {other}a)) a on a._ord = x._ord"
    )


def _coverage(spark, sf_dir):
    return matching.coverage(
        people(spark, sf_dir), board(spark, sf_dir), "last_name", "first_name",
        [("primary_address_1", "primary_city", "zip5"), ("mailing_address_1", "mailing_city", "mailing_postal_code")],
        "full_name", ("primary_address_1", "primary_city", "zip5"))


@query("e5_coverage_providers", sql.with_inputs("p m", _coverage_sql("p", "m", "in_mailing_list"), **_COVER))
def _cover_providers(spark, sf_dir):
    return _coverage(spark, sf_dir)[0].select("_ord", "in_mailing_list", "match_method")


@query("e5_coverage_mailing", sql.with_inputs("p m", _coverage_sql("m", "p", "in_provider_file"), **_COVER))
def _cover_mailing(spark, sf_dir):
    return _coverage(spark, sf_dir)[1].select("_ord", "in_provider_file", "match_method")


@query("e6_duplicates_between", sql.with_inputs(
    "p m", "select _ord, n as \"duplicate_of_A\", case when n then 'name' else 'unique' end as match_method from (select _ord, _ord in "
    "(select _ord from pn where k <> '' and k in (select k from mn)) as n from p)", pn=_COVER["pn"], mn=_COVER["mn"]))
def _duplicates(spark, sf_dir):
    flagged = matching.duplicates_between(
        board(spark, sf_dir), people(spark, sf_dir), matching.roster_names("full_name", None, None), "primary_city",
        matching.roster_names(None, "last_name", "first_name"), "primary_city")
    return flagged.select("_ord", "duplicate_of_A", "match_method")


# --- E7, E8 ------------------------------------------------------------------------------------


def ranked_sql(source: str) -> str:
    """(_ord, k, rank) of a source with ranked keys."""
    return (f"select _ord, keys[i] as k, i as rank from (select _ord, keys, unnest(generate_series(1, len(keys))) as i from ({source})) "
            "where keys[i] is not null")


_LOOK = dict(
    pk=ranked_sql(sql.mixed_keys("p", "last_name", "first_name")),
    rk="select k, min(_ord) as ro from (" + ranked_sql(sql.mixed_keys("m", "last_name", "first_name")) + ") group by k",
    best="select _ord, arg_min(ro, rank * 1000000000 + ro) as ro from pk join rk using (k) group by _ord",
)


@query("e7_lookup_first", sql.with_inputs(
    "p m", "select p._ord, m.npi as master_npi, m.full_name as master_name from p left join best on best._ord = p._ord left join m on m._ord = best.ro", **_LOOK))
def _lookup(spark, sf_dir):
    left = people(spark, sf_dir).select("_ord", "last_name", "first_name")
    rows = matching.lookup_first(
        left, board(spark, sf_dir), names.mixed_name_keys("last_name", "first_name"),
        names.mixed_name_keys("last_name", "first_name"), ["npi", "full_name"])
    return rows.select("_ord", F.col("__hit.npi").alias("master_npi"), F.col("__hit.full_name").alias("master_name"))


_LIC = dict(
    pk=ranked_sql(sql.mixed_keys("p", "last_name", "first_name", True)),
    rk="select k, min(_ord) as ro from (" + ranked_sql(sql.mixed_keys("m", "last_name", "first_name", True)) + ") group by k",
    best="select _ord, arg_min(ro, (rank + case when contains(k, '|~') then 1000 else 0 end) * 1000000000 + ro) as ro, "
         "bool_or(not contains(k, '|~')) as exact from pk join rk using (k) group by _ord",
)
_LIC_ROWS = (
    "select p._ord, case when best.ro is null then '' when m.last_name = '' then m.first_name when m.first_name = '' then m.last_name "
    "else m.last_name || ', ' || m.first_name end as license_name_match, case when best.ro is null then '' when exact then 'exact' "
    "else 'initial_match' end as match_type, coalesce(m.specialty_boards, '') as specialty_boards, coalesce(m.certification, '') as certification, "
    "coalesce(m.email, '') as email, case when trim(m.specialty_boards) = '' then 'missing' else '' end as specialty_boards_missing, "
    "case when trim(m.certification) = '' then 'missing' else '' end as certification_missing from p left join best on best._ord = p._ord "
    "left join m on m._ord = best.ro"
)


def _license(spark, sf_dir):
    left = people(spark, sf_dir).select("_ord", "last_name", "first_name")
    return matching.license_lookup(left, board(spark, sf_dir)).drop("last_name", "first_name")


@query("e8_license_lookup", sql.with_inputs("p m", _LIC_ROWS, **_LIC))
def _license_all(spark, sf_dir):
    return _license(spark, sf_dir)


@query("e8_license_no_email", sql.with_inputs("p m", f"select * from ({_LIC_ROWS}) where match_type <> '' and trim(email) = ''", **_LIC))
def _license_no_email(spark, sf_dir):
    return matching.with_and_without_email(_license(spark, sf_dir))[1]


# --- E9, E10 -----------------------------------------------------------------------------------

_ZA = f"{sql.norm('primary_address_1')} || '|' || {sql.zip5('zip5')}"


@query("e9_address_label_join", sql.with_inputs(
    "p m", f"select p._ord, coalesce(f.hs, '') as health_system, coalesce(f.c, '') as health_system_city from p left join (select {_ZA} as k, "
    f"arg_min({sql.norm('health_system')}, _ord) as hs, arg_min({sql.norm('health_system_city')}, _ord) as c from m "
    f"where {sql.norm('health_system')} <> '' group by 1) f on f.k = {_ZA.replace('primary_address_1', 'p.primary_address_1').replace('zip5', 'p.zip5')}"))
def _label_join(spark, sf_dir):
    left = people(spark, sf_dir).select("_ord", "primary_address_1", "zip5")
    done = matching.address_label_join(left, board(spark, sf_dir), "primary_address_1", "zip5", "primary_address_1", "zip5")
    return done.select("_ord", "health_system", "health_system_city")


_CAT = f"coalesce(nullif({sql.credential('credential')}, ''), nullif({sql.credential('license_type_desc')}, ''))"
_SRC = (f"select 0 as rank, _ord, {_NK} as k, '' as credential, license_type_desc, specialty_boards, certification, '' as taxonomy_descriptions from m "
        f"union all select 1, _ord, {_NK}, credential, '', '', '', taxonomy_descriptions from p")


@query("e10_add_titles", sql.with_inputs(
    "p m", f"select x._ord, coalesce({sql.title_of('f.c')}, '') as title from (select _ord, {_NK} as k from m) x left join "
    "(select k, arg_min(c, rank * 1000000000 + _ord) as c from (select *, " + _CAT + " as c from src) where c is not null and k <> '|' group by k) f on f.k = x.k",
    src=_SRC))
def _titles(spark, sf_dir):
    left = board(spark, sf_dir).select("_ord", "last_name", "first_name")
    done = matching.add_titles(
        left, [board(spark, sf_dir), people(spark, sf_dir)], ["credential", "license_type_desc"])
    return done.select("_ord", "title")


_TAX = fq._ENTRY
_SPEC = (f"case when trim(specialty_boards) not in ('', '(empty)') then trim(specialty_boards) else trim(split_part({_TAX}, ',', 1)) end")
_SUB = (f"case when trim(specialty_boards) not in ('', '(empty)') then case when trim(certification) = '(empty)' then '' else trim(certification) end "
        f"when contains({_TAX}, ',') then trim(substr({_TAX}, strpos({_TAX}, ',') + 1)) else '' end")


@query("e10_add_columns", sql.with_inputs(
    "p m", "select x._ord, coalesce(f.title, '') as title, coalesce(f.specialty, '') as specialty, coalesce(f.subspecialty, '') as subspecialty "
    f"from (select _ord, {_NK} as k from m) x left join (select * from (select *, {sql.title_of(_CAT)} as title, {_SPEC} as specialty, {_SUB} as subspecialty, "
    "row_number() over (partition by k order by rank, _ord) as rn from src) where rn = 1 and k <> '|') f on f.k = x.k", src=_SRC))
def _columns(spark, sf_dir):
    left = board(spark, sf_dir).select("_ord", "last_name", "first_name")
    sources = [board(spark, sf_dir).withColumnRenamed("specialty_boards", "specialty boards"), people(spark, sf_dir)]
    done = matching.add_columns(left, sources, ["credential", "license_type_desc"])
    return done.select("_ord", "title", "specialty", "subspecialty")


# --- E11, E12 ----------------------------------------------------------------------------------

_PERSON = f"{sql.norm('last_name')} || ' ' || {sql.norm('first_name')}"
_FIX = {"primary_address_1": "primary_address_1", "primary_address_2": "primary_address_2", "primary_city": "primary_city",
        "primary_state": "primary_state", "zip5": "zip5"}


def _latest(c: str) -> str:
    return (f"arg_max(trim({c}), _ord) filter (where trim({c}) <> '') as n_{c}, min({sql.norm(c)}) filter (where trim({c}) <> '') as lo_{c}, "
            f"max({sql.norm(c)}) filter (where trim({c}) <> '') as hi_{c}")


_DIFFERS = {c: f"(f.n_{c} is not null and (f.lo_{c} <> {sql.norm('t.' + c)} or f.hi_{c} <> {sql.norm('t.' + c)}))"
            for c in ("primary_address_1", "primary_city")}


@query("e11_apply_corrections", sql.with_inputs(
    "p m",
    "select t._ord, "
    + ", ".join(f"case when t.last and {d} then f.n_{c} else t.{c} end as {c}" for c, d in _DIFFERS.items())
    + ", " + ", ".join(f"case when t.last and f.n_{c} is not null then f.n_{c} else t.{c} end as {c}" for c in ("primary_address_2", "primary_state", "zip5"))
    + f", case when t.last and (f.n_primary_address_2 is not null or {' or '.join(_DIFFERS.values())}) then 'Y' else '' end as address_updated "
    "from t left join f on f.k = t.k",
    t=f"select *, {_PERSON} as k, _ord = max(_ord) over (partition by {_PERSON}) as last from p",
    f=f"select {_PERSON} as k, {', '.join(_latest(c) for c in _FIX)} from m where trim({_PERSON}) <> '' group by 1"))
def _corrections(spark, sf_dir):
    rows, _ = matching.apply_corrections(
        people(spark, sf_dir), board(spark, sf_dir), _FIX, line2="primary_address_2", silent=("primary_state", "zip5"))
    return rows.select("_ord", *_FIX, "address_updated")


@query("e11_corrections_not_found", sql.with_inputs(
    "p m", f"select _ord, last_name, first_name from m where trim({_PERSON}) = '' or {_PERSON} not in (select {_PERSON} from p)"))
def _not_found(spark, sf_dir):
    _, missing = matching.apply_corrections(people(spark, sf_dir), board(spark, sf_dir), _FIX)
    return missing.select("_ord", "last_name", "first_name")


_RKEY = (f"case when {sql.known('npi')} <> '' then 'npi:' || {sql.known('npi')} when {sql.norm('last_name')} || {sql.norm('first_name')} <> '' "
         f"and {sql.norm('primary_address_1')} <> '' then 'name:' || {sql.norm('last_name')} || '|' || {sql.norm('first_name')} || '|' || {sql.norm('primary_address_1')} end")
_NOTED = (f"select *, {sql.known('note2')} as nt from (select t.*, case when trim(t.note) <> '' then t.note when t.last then coalesce(f.n, '') else '' end as note2 "
          "from t left join f on f.k = t.k)")
_TAKE = f"nt <> '' and not {sql.bad_label('nt')} and not {sql.individual_label('nt')}"
REVIEWS = "concat('Review ', license_nbr)"


@query("e12_merge_annotations", sql.with_inputs(
    "m",
    f"select _ord, note2 as note, case when {_TAKE} then case when lower(nt) in ('solo practice', 'solo') then 'Solo Practice' "
    "when lower(nt) in ('group practice', 'group') then 'Group Practice' else nt end else health_system end as health_system, "
    f"case when {_TAKE} and trim(health_system_city) = '' then {sql.known('primary_city')} else health_system_city end as health_system_city, "
    f"case when {_TAKE} then 'yes' else '' end as _user_reviewed from n",
    t=f"select *, {_RKEY} as k, {_RKEY} is not null and _ord = max(_ord) over (partition by {_RKEY}) as last from m",
    f="select k, arg_min(n, o) as n from (select "
      f"{_RKEY} as k, -_ord as o, case when _ord % 4 = 0 then 'group' when _ord % 4 = 1 then 'Annex ' || license_nbr when _ord % 4 = 2 then 'Dept of Care' else ' nan ' end as n from m) "
      "where k is not null and lower(trim(n)) not in ('', 'nan') group by k",
    n=_NOTED))
def _annotations(spark, sf_dir):
    rows = board(spark, sf_dir)
    reviews = rows.withColumn("note", F.expr(
        "case when _ord % 4 = 0 then 'group' when _ord % 4 = 1 then 'Annex ' || license_nbr when _ord % 4 = 2 then 'Dept of Care' else ' nan ' end"
    )).withColumn("_ord", -F.col("_ord"))
    done = matching.merge_annotations(rows, reviews, "note")
    return done.select("_ord", "note", "health_system", "health_system_city", "_user_reviewed")


# --- E13, E14 ----------------------------------------------------------------------------------


def _entry(addr: str, city: str, zip_: str):
    return F.struct(text.filled(addr).alias("addr"), text.filled(city).alias("city"), text.filled(zip_).alias("zip"))


def _compare(spark, sf_dir, method: str = "lev"):
    keys = names.mixed_name_keys("last_name", "first_name")
    own = F.array(_entry("primary_address_1", "primary_city", "zip5"), _entry("mailing_address_1", "mailing_city", "mailing_postal_code"))
    theirs = F.array(_entry("primary_address_1", "primary_city", "zip5"))
    return matching.compare_addresses(
        people(spark, sf_dir), board(spark, sf_dir), keys, keys, own, theirs, ref_name=F.col("full_name"), method=method
    ).select("_ord", "address_match", "ref_name")


_STRICT = {n: sql.strict_key(a, c, z) for n, (a, c, z) in {
    "k1": ("primary_address_1", "primary_city", "zip5"), "k2": ("mailing_address_1", "mailing_city", "mailing_postal_code")}.items()}


@query("e13_addresses_same", sql.with_inputs(
    "p m", "select x._ord, case when best.ro is null then 'not_found' when y.k1 in (x.k1, x.k2) then 'same' else 'other' end as address_match, "
    "coalesce(m.full_name, '') as ref_name from x left join best on best._ord = x._ord left join y on y._ord = best.ro left join m on m._ord = best.ro",
    **_LOOK, x=f"select _ord, {_STRICT['k1']} as k1, {_STRICT['k2']} as k2 from p", y=f"select _ord, {_STRICT['k1']} as k1 from m"))
def _same(spark, sf_dir):
    other = F.when(F.col("address_match").isin("possible_match", "different"), "other").otherwise(F.col("address_match"))
    return _compare(spark, sf_dir, "blocks").withColumn("address_match", other)


def _closeness(own: str) -> str:
    longer = f"greatest(length({own}), length(y.k1))"
    return f"case when x.a{own[-1]} = '' or y.a1 = '' then 0.0 when {longer} = 0 then 1.0 else 1 - levenshtein({own}, y.k1) / {longer} end"


@query("e13_compare_addresses", sql.with_inputs(
    "p m", "select x._ord, case when best.ro is null then 'not_found' when y.a1 <> '' and ((x.a1 <> '' and y.k1 = x.k1) or (x.a2 <> '' and y.k1 = x.k2)) then 'same' "
    f"when greatest({_closeness('x.k1')}, {_closeness('x.k2')}) >= {fv.FUZZY_THRESHOLD} then 'possible_match' else 'different' end as address_match, "
    "coalesce(m.full_name, '') as ref_name from x left join best on best._ord = x._ord left join y on y._ord = best.ro left join m on m._ord = best.ro",
    **_LOOK,
    x=f"select _ord, {_STRICT['k1']} as k1, {_STRICT['k2']} as k2, {sql.norm('primary_address_1')} as a1, {sql.norm('mailing_address_1')} as a2 from p",
    y=f"select _ord, {_STRICT['k1']} as k1, {sql.norm('primary_address_1')} as a1 from m"))
def _verdicts(spark, sf_dir):
    return _compare(spark, sf_dir)


_PLACES = {
    "pl": fq.PLACE_LABEL_SQL,
    "q": f"select *, case when {sql.norm('last_name')} = '' then '' else array_to_string(list_filter([{sql.strip('first_name')}, {sql.strip('last_name')}, "
         f"array_to_string(({sql.word_list('license_type_desc')})[1:3], ' '), {sql.strip('primary_city')}, {sql.strip('primary_state')}], lambda x: x <> ''), ' ') || ' physician' end as query from m",
}


def _search_places(spark, sf_dir):
    """Places found by a name query, derived from the board itself."""
    rows = board(spark, sf_dir)
    query_text = labelling.name_query("last_name", "first_name", None, "primary_city", "primary_state", "license_type_desc")
    return rows, query_text, rows.select(
        query_text.alias("query_key"), F.concat(F.lit("Clinic "), F.col("license_nbr")).alias("name"),
        F.array(F.lit("store")).alias("types"), F.lit("store").alias("primary_type"),
        F.concat(F.lit("1 Main, "), F.col("license_nbr"), F.lit(", MN, USA")).alias("formatted_address"), F.col("_ord"))


@query("e14_enrich_by_name", sql.with_inputs(
    "m", "select q._ord, case when trim(q.health_system) = '' and f.l is not null then f.l else q.health_system end as health_system, "
    "case when trim(q.health_system) = '' and f.l is not null then f.c else q.health_system_city end as health_system_city from q left join "
    "(select query, arg_min('Clinic ' || license_nbr, _ord) as l, arg_min(license_nbr, _ord) as c from q where query <> '' group by query) f "
    "on f.query = q.query", q=_PLACES["q"]))
def _by_name(spark, sf_dir):
    rows, query_text, found = _search_places(spark, sf_dir)
    done = labelling.enrich_places(rows, found, query_text, "primary_city", place_order="_ord")
    return done.select("_ord", "health_system", "health_system_city")


_AQ = ("case when regexp_matches(primary_address_1, '(?i)^\\s*p\\.?\\s*o\\.?\\s*box\\b') then 'clinic hospital ' || trim(primary_city) || ' ' || trim(zip5) "
       "else trim(primary_address_1) || ' ' || trim(primary_city) || ' ' || trim(zip5) end")
_PER = f"{sql.norm('primary_address_1')} || '|' || {sql.norm('primary_city')}"


@query("e14_enrich_by_address", sql.with_inputs(
    "m", "select m._ord, case when trim(m.health_system) = '' and f.l is not null then f.l else m.health_system end as health_system, "
    "case when trim(m.health_system) = '' and f.l is not null then f.c else m.health_system_city end as health_system_city from m left join o on o._ord = m._ord "
    "left join f on f.query = o.query",
    o=f"select _ord, first_value({_AQ}) over (partition by {_PER} order by _ord) as query from m where trim(health_system) = ''",
    f=f"select {_AQ} as query, arg_min('Hospital ' || license_nbr, _ord) as l, arg_min('Town ' || license_nbr, _ord) as c from m group by 1"))
def _by_address(spark, sf_dir):
    rows = board(spark, sf_dir)
    query_text = labelling.address_query("primary_address_1", "primary_city", "zip5")
    found = rows.select(
        query_text.alias("query_key"), F.concat(F.lit("Hospital "), F.col("license_nbr")).alias("name"),
        F.array(F.lit("x")).alias("types"), F.lit("").alias("primary_type"),
        F.concat(F.lit("a, Town "), F.col("license_nbr"), F.lit(", MN, USA")).alias("formatted_address"), F.col("_ord"))
    per = F.concat_ws("|", text.norm("primary_address_1"), text.norm("primary_city"))
    done = labelling.enrich_places(rows, found, query_text, "primary_city", place_order="_ord", per=per)
    return done.select("_ord", "health_system", "health_system_city")

