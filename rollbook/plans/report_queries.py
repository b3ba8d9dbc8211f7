"""Consolidation, wide tables, overlaps, labels and address classification over the people and board tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions import names, text
from rollbook.operators import classifying, comparing, dedup, labelling, matching, reporting
from rollbook.plans import match_queries as mq
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


BC, PC = list(BOARD), list(PEOPLE)


def _boards_named(spark, sf_dir):
    return board(spark, sf_dir).withColumnRenamed("specialty_boards", "specialty boards")


# --- F1, F2 ------------------------------------------------------------------------------------


@query("f1_consolidate", sql.with_inputs("m", "select * from mc", **mq.CONSOLIDATED))
def _consolidate(spark, sf_dir):
    done = reporting.consolidate(_boards_named(spark, sf_dir))
    return done.withColumnRenamed("specialty boards", "specialty_boards")


@query("f1_consolidate_by_name", sql.with_inputs(
    "m", "select mg.o as _ord, n as _mn_specialty_count, " + ", ".join(
        f"case when n > 1 then coalesce(mj{i}.{c}, '') else f.{c} end as {c}" for i, c in enumerate(mq._JOINED))
    + " from mg join mk0 f on f._ord = mg.o " + " ".join(f"left join mj{i} on mj{i}.ak = mg.ak" for i in range(len(mq._JOINED))),
    **{k: (f"select *, {mq._NK} as ak from m" if k == "mk0" else v) for k, v in mq.CONSOLIDATED.items() if k != "mc"}))
def _consolidate_by_name(spark, sf_dir):
    rows = _boards_named(spark, sf_dir)
    done = reporting.consolidate(rows, names.name_key("last_name", "first_name"))
    return done.withColumnRenamed("specialty boards", "specialty_boards").select("_ord", "_mn_specialty_count", *mq._JOINED)


# columns of the wide table: registry names, board names, board-only texts
_LEFT_WIDE = {fv.REGISTRY_WIDE_NAMES.get(c, c): c for c in PC if c not in ("_ord",)}
_RIGHT_WIDE = {fv.BOARD_WIDE_NAMES.get(c, c): c for c in (
    "primary_address_1", "primary_address_2", "primary_city", "primary_state", "zip5", "source_file", "full_name",
    "license_type_desc", "license_nbr", "specialty_boards", "certification", "email", "discipined", "health_system",
    "health_system_city", "note")}


@query("f2_pivot_wide", sql.with_inputs(
    "p m",
    "select l.k as _name_key, " + ", ".join(f"l.{c} as {n}" for n, c in _LEFT_WIDE.items()) + ", "
    + ", ".join(f"coalesce(w{i}.{c}, '') as {n}" for i, (n, c) in enumerate(_RIGHT_WIDE.items()))
    + " from l " + " ".join(f"left join w{i} on w{i}.k = l.k" for i in range(len(_RIGHT_WIDE))),
    l=f"select * exclude (rn) from (select *, {mq._NK} as k, row_number() over (partition by {mq._NK} order by _ord) as rn from p) where rn = 1",
    r=f"select *, {mq._NK} as k from m",
    **{f"w{i}": mq.joined_sql(c, "k", "r") for i, c in enumerate(_RIGHT_WIDE.values())}))
def _wide(spark, sf_dir):
    key = names.name_key("last_name", "first_name")
    left, right = people(spark, sf_dir).withColumn("_name_key", key), board(spark, sf_dir).withColumn("_name_key", key)
    wide = reporting.pivot_wide(left.withColumn("key_copy", F.col("_name_key")), right)
    return wide.withColumnRenamed("key_copy", "_name_key")


# --- F3, F4, F27 -------------------------------------------------------------------------------

_WHO = (f"{sql.clean_name('last_name', True)} || '|' || split_part({sql.clean_name('first_name', True)}, ' ', 1)")
_SLOTS = dict(
    r=f"select *, case when {_WHO} = '|' then 'row' || _ord else {_WHO} end as who, {sql.norm('primary_city')} as a, "
      f"{sql.norm('source_file')} as c, {sql.zip5('status')} as z from p",
    s="select who, a, c, z, min(_ord) as o from r group by who, a, c, z",
)


_PLACES = {"addr": "primary_city", "city": "source_file", "zip_": "status"}


def _address_slots(spark, sf_dir):
    return reporting.address_slots(people(spark, sf_dir), **_PLACES)


def _wide_addresses(spark, sf_dir, slots):
    return reporting.addresses_wide(people(spark, sf_dir), **_PLACES, slots=slots)


@query("f3_address_slots", sql.with_inputs(
    "p", "select min(s.o) over (partition by s.who) as person, cast(row_number() over (partition by s.who order by s.o) as integer) as slot, s.o as at, x.primary_city as address, "
    "x.source_file as city, x.status as zip from s join p x on x._ord = s.o", **_SLOTS))
def _slots(spark, sf_dir):
    return _address_slots(spark, sf_dir)


@query("f3_addresses_wide", sql.with_inputs(
    "p", "select f._ord, t.n as num_addresses, t.addrs as all_addresses from (select who, cast(count(*) as integer) as n, "
    "string_agg(x.primary_city || '/' || x.source_file || '/' || x.status, ' || ' order by s.o) as addrs, min(s.o) as first "
    "from s join p x on x._ord = s.o group by who) t join p f on f._ord = t.first", **_SLOTS))
def _addresses_wide(spark, sf_dir):
    n = _address_slots(spark, sf_dir).agg(F.max("slot")).first()[0] or 0  # this table is to show all of them
    wide, _ = _wide_addresses(spark, sf_dir, n)
    slots = [F.when(F.col("num_addresses") >= i, F.concat_ws("/", f"address_{i}", f"city_{i}", f"zip_{i}")) for i in range(1, n + 1)]
    return wide.select("_ord", "num_addresses", F.concat_ws(" || ", *slots).alias("all_addresses"))


@query("f3_addresses_dropped", sql.with_inputs(
    "p", "select r.last_name, r.first_name, r.primary_city as dup_address, r.source_file as dup_city, r.status as dup_zip, r.a as norm_addr, "
    "r.c as norm_city, r.z as norm_zip, (select string_agg(s.a || '|' || s.c || '|' || s.z, ' || ' order by s.o) from s where s.who = r.who and s.o < r._ord) "
    "as all_seen from r join s t on t.who = r.who and t.a = r.a and t.c = r.c and t.z = r.z where r._ord <> t.o and r.a <> ''", **_SLOTS))
def _addresses_dropped(spark, sf_dir):
    return _wide_addresses(spark, sf_dir, 1)[1]


@query("f27_reconcile", sql.with_inputs(
    "p", "select i as input_rows, u as unique_rows, t - u as extra_slots, i - t as dropped_rows, i as accounted, cast(0 as bigint) as difference from "
    "(select (select count(*) from p) as i, (select count(distinct who) from r) as u, (select count(*) from s) as t)", **_SLOTS))
def _reconcile(spark, sf_dir):
    wide, dropped = _wide_addresses(spark, sf_dir, 1)
    return reporting.reconcile(people(spark, sf_dir), wide, dropped)


# --- F5 ----------------------------------------------------------------------------------------

_IDS = (f"select distinct case when {sql.norm('npi')} not in ('', 'nan') then 'npi' else 'name' end as match_type, case when {sql.norm('npi')} not in ('', 'nan') "
        f"then {sql.norm('npi')} else {sql.norm('last_name')} || '|' || {sql.norm('first_name')} || '|' || substr({sql.norm('middle_name')}, 1, 1) end as identifier, "
        "source_file || ' / ' || tab as source, source_file as file from (select npi, last_name, first_name, middle_name, source_file, source_tab as tab from p "
        "union all select npi, last_name, first_name, middle_name, source_file, 'all' from m)")


def _ids(spark, sf_dir, source="source_file"):
    rows = people(spark, sf_dir).select("npi", "last_name", "first_name", "middle_name", "source_file", F.col("source_tab").alias("tab"))
    rows = rows.unionByName(board(spark, sf_dir).select("npi", "last_name", "first_name", "middle_name", "source_file", F.lit("all").alias("tab")))
    rows = rows.withColumn("source", F.concat_ws(" / ", "source_file", "tab"))
    return reporting.identifiers(rows, "npi", "last_name", "first_name", "middle_name", source)


@query("f5_overlap_matrix", sql.with_inputs(
    "p m", "select *, shared_by_npi + shared_by_name as total_shared from (select a.file as file_1, b.file as file_2, "
    + ", ".join(f"(select count(*) from (select identifier from ids where match_type = '{k}' and file = a.file and identifier <> '||' intersect "
                f"select identifier from ids where match_type = '{k}' and file = b.file)) as shared_by_{k}" for k in ("npi", "name"))
    + " from files a join files b on a.file < b.file)",
    ids=_IDS, files="select distinct file from ids"))
def _overlap(spark, sf_dir):
    return reporting.overlap_matrix(_ids(spark, sf_dir), zeros=True)


@query("f5_overlap_details", sql.with_inputs(
    "p m", "select match_type, identifier, case when match_type = 'name' then split_part(identifier, '|', 1) else '' end as last, "
    "case when match_type = 'name' then split_part(identifier, '|', 2) else '' end as first, case when match_type = 'name' then split_part(identifier, '|', 3) else '' end "
    "as middle_initial, string_agg(distinct file, ' | ' order by file) as files, string_agg(distinct source, ' | ' order by source) as sources "
    "from ids where identifier <> '||' group by match_type, identifier having count(distinct file) > 1", ids=_IDS))
def _details(spark, sf_dir):
    return reporting.overlap_details(_ids(spark, sf_dir, "source"))


# --- F6, F7, F8 --------------------------------------------------------------------------------


@query("f6_value_counts", sql.with_inputs("p", "select credential, status, count(*) as n from p group by all"))
def _value_counts(spark, sf_dir):
    return reporting.value_counts(people(spark, sf_dir), ["credential", "status"])


@query("f6_source_breakdown", sql.with_inputs("p", "select source_file, source_tab, count(*) as row_count from p group by all"))
def _breakdown(spark, sf_dir):
    return reporting.source_breakdown(people(spark, sf_dir), "source_file", "source_tab")


_BY_CITY = "select health_system, health_system_city as city, count(*) as providers from m where health_system <> '' group by all"


@query("f7_rank_labels", sql.with_inputs(
    "m", "select *, row_number() over (order by total_providers desc, health_system) as rank from (select health_system, cast(sum(providers) as bigint) as total_providers, "
    "string_agg(case when city = '' then '(unknown)' else city end || ' (' || providers || ')', ', ' order by providers desc, city) as cities from b group by 1)", b=_BY_CITY))
def _ranked(spark, sf_dir):
    return reporting.rank_labels(board(spark, sf_dir))[0]


@query("f7_labels_by_city", sql.with_inputs("m", _BY_CITY))
def _by_city(spark, sf_dir):
    return reporting.rank_labels(board(spark, sf_dir))[1]


def _sets_sql(columns: list[tuple[str, str, str]]) -> str:
    keys = ", ".join(out for out, _, _ in columns)
    a = ", ".join(f"{sql.norm(x)} as {out}" for out, x, _ in columns)
    b = ", ".join(f"{sql.norm(y)} as {out}" for out, _, y in columns)
    return (f"select {keys}, coalesce(na, 0) as a_providers, coalesce(nb, 0) as b_providers, case when nb is null then 'only_in_a' when na is null then 'only_in_b' "
            f"else 'in_both' end as status from (select {a}, count(*) as na from p group by all) full join (select {b}, count(*) as nb from m group by all) "
            f"using ({keys}) where {columns[0][0]} <> ''")


@query("f8_label_set_compare", sql.with_inputs("p m", _sets_sql([("primary_city", "primary_city", "primary_city")])))
def _label_sets(spark, sf_dir):
    return reporting.label_set_compare(people(spark, sf_dir), board(spark, sf_dir), [("primary_city", "primary_city")])


@query("f8_label_city_compare", sql.with_inputs(
    "p m", _sets_sql([("last_name", "last_name", "last_name"), ("primary_city", "primary_city", "primary_city")])))
def _label_city_sets(spark, sf_dir):
    return reporting.label_set_compare(
        people(spark, sf_dir), board(spark, sf_dir), [("last_name", "last_name"), ("primary_city", "primary_city")])


# --- labels ------------------------------------------------------------------------------------

_BASE = f"select *, {sql.base_key('primary_address_1', 'primary_city')} as k from m"
_NOISE = f"({sql.bad_label('health_system')} or {sql.individual_label('health_system')})"


def _vote(where: str) -> str:
    return ("select k, l, c from (select *, row_number() over (partition by k order by n desc, o) as rn from (select k, trim(health_system) as l, "
            f"trim(health_system_city) as c, count(*) as n, min(_ord) as o from b where trim(health_system) <> '' and {where} group by 1, 2, 3)) where rn = 1")


def _take(test: str) -> str:
    return (f"select b._ord, case when {test} and v.l is not null then v.l else b.health_system end as health_system, "
            f"case when {test} and v.l is not null then v.c else b.health_system_city end as health_system_city from b left join v on v.k = b.k")


@query("f9_majority_label", sql.with_inputs("m", _take("trim(b.health_system) = ''"), b=_BASE, v=_vote(f"not {_NOISE}")))
def _majority(spark, sf_dir):
    return labelling.majority_label(board(spark, sf_dir), "primary_address_1", "primary_city").select("_ord", labelling.LABEL, labelling.CITY)


@query("f9_majority_label_any", sql.with_inputs("m", _take("trim(b.health_system) = ''"), b=_BASE, v=_vote("true")))
def _majority_any(spark, sf_dir):
    done = labelling.majority_label(board(spark, sf_dir), "primary_address_1", "primary_city", exclude_noise=False)
    return done.select("_ord", labelling.LABEL, labelling.CITY)


@query("f10_upgrade_generic", sql.with_inputs(
    "m", _take("b.health_system in ('Solo Practice', 'Group Practice') and b._ord % 3 <> 0"), b=_BASE,
    v=_vote(f"not {_NOISE} and trim(health_system) not in ('Solo Practice', 'Group Practice')")))
def _upgrade(spark, sf_dir):
    rows = board(spark, sf_dir).withColumn("_user_reviewed", F.when(F.col("_ord") % 3 == 0, "yes").otherwise(""))
    return labelling.upgrade_generic(rows, "primary_address_1", "primary_city").select("_ord", labelling.LABEL, labelling.CITY)


@query("f11_label_by_count", sql.with_inputs(
    "m", "select _ord, case when trim(health_system) <> '' then health_system when count(*) over (partition by k) >= 2 then 'Group Practice' else 'Solo Practice' end "
    f"as health_system, case when trim(health_system) <> '' then health_system_city else {sql.known('primary_city')} end as health_system_city from b", b=_BASE))
def _by_count(spark, sf_dir):
    return labelling.label_by_count(board(spark, sf_dir), "primary_address_1", "primary_city").select("_ord", labelling.LABEL, labelling.CITY)


_SUMMARY = ("select health_system, count(*) as provider_count, cast(count(distinct c) filter (where c <> '') as integer) as location_count, "
            f"coalesce(string_agg(distinct {sql.title('c')}, ', ' order by {sql.title('c')}) filter (where c <> ''), '') as cities from (select health_system, "
            f"{sql.norm('health_system_city')} as c from m where health_system not in ('', 'Solo Practice', 'Group Practice')) group by 1")


@query("f12_label_summary", sql.with_inputs("m", _SUMMARY))
def _summary(spark, sf_dir):
    return labelling.label_summary(board(spark, sf_dir))


@query("f12_label_summary_top", sql.with_inputs("m", f"{_SUMMARY} order by provider_count desc, health_system limit 3"))
def _summary_top(spark, sf_dir):
    return labelling.label_summary(board(spark, sf_dir), top=3)


# --- F25, F26, F28 -----------------------------------------------------------------------------


def _profile_sql(i: int, c: str) -> str:
    return (f"select {i} as position, '{c}' as \"column\", count(*) as rows, coalesce(case when length(e) > 60 then e[1:57] || '...' else e end, '(empty)') as example from "
            f"(select arg_min({c}, _ord) filter (where trim({c}) <> '') as e, count(*) as n from m) join m on true group by e")


@query("f25_profile", sql.with_inputs("m", " union all ".join(_profile_sql(i, c) for i, c in enumerate(c for c in BC if c != "_ord"))))
def _profile(spark, sf_dir):
    return reporting.profile(board(spark, sf_dir))


@query("f26_check_counts", sql.with_inputs(
    "p m", "select 'people' as \"check\", count(*) as count from p union all select 'board', count(*) from m union all "
    "select 'duplicate npi', count(*) from p where npi <> '' and npi in (select npi from p group by 1 having count(*) > 1)"))
def _checks(spark, sf_dir):
    registry = people(spark, sf_dir)
    return reporting.check_counts(
        {"people": registry, "board": board(spark, sf_dir), "duplicate npi": dedup.duplicate_rows(registry, "npi")})


@query("f26_check_summary", sql.with_inputs(
    "p m", "select source_tab, count(*) as total, cast(sum(case when npi <> '' and npi in (select npi from m) then 1 else 0 end) as bigint) as in_mailed, "
    "cast(sum(case when npi <> '' and npi in (select npi from m) then 0 else 1 end) as bigint) as not_in_mailed from p group by 1"))
def _check_summary(spark, sf_dir):
    number = {"npi": F.array(text.norm("npi"))}
    flagged = matching.match_cascade(people(spark, sf_dir), board(spark, sf_dir), number, number, found="in_mailed")
    return reporting.check_summary(flagged, "source_tab", "in_mailed")


@query("f28_flag_breakdown", sql.with_inputs(
    "m", "select flag, count(*) as n from (select unnest([case when trim(primary_address_2) = '' and trim(email) = '' then 'missing_address' end, "
    "case when trim(note) = '' then 'missing_state' end, case when trim(zip5) = '' then 'missing_zip' end]) as flag from m) where flag is not null group by 1"))
def _flags(spark, sf_dir):
    from rollbook.functions.addresses import missing_flags

    rows = board(spark, sf_dir).select(missing_flags(["primary_address_2", "email"], "note", "zip5").alias("flags"))
    return reporting.flag_breakdown(rows, "flags")


# --- G1, G2 ------------------------------------------------------------------------------------

_A1, _A2 = ("primary_address_1", "primary_city", "zip5"), ("mailing_address_1", "mailing_city", "mailing_postal_code")


def _raw(a: str, c: str, z: str) -> str:
    return f"{sql.norm(a)} || '|' || {sql.norm(c)} || '|' || {sql.zip5(z)}"


def _entries_sql(profile: str, states: bool) -> str:
    parts = []
    for i, (a, c, z) in enumerate((_A1, _A2)):
        nk = sql.norm_addr(a, profile) if profile == "round2" else f"{sql.norm_addr(a, profile)} || '|' || {sql.norm(c)} || '|' || {sql.zip5(z)}"
        where = f"{sql.norm(a)} <> ''" + (f" and {sql.norm('primary_state')} in ('', 'mn', 'wi')" if states and i == 0 else "")
        parts.append(f"select _ord as ro, {sql.norm('npi')} as npi, substr({sql.norm('middle_name')}, 1, 1) as mid, _ord * 2 + {i} as pos, {_raw(a, c, z)} as raw, {nk} as nk from p where {where}")
    return " union all ".join(parts)


_PEOPLE_KEYS = sql.name_variants("(select _ord, last_name, first_name from p)", "last_name", "first_name")
_PEOPLE_VERDICT = (
    "select _ord, count(distinct npi) filter (where npi <> '') as npis, count(distinct mid) filter (where mid <> '') as mids, "
    "string_agg(distinct npi, ' | ' order by npi) filter (where npi <> '') as npi_text from met group by _ord"
)
_COLLISION = "(v.npis > 1 or v.mids > 1)"
_COMMON = (f"when {_COLLISION} then 'name_collision_different_people' when a.n = 1 then 'unique'")
_COUNT = (f"coalesce(case when {_COLLISION} then case when v.npis > 0 then v.npis else v.mids end else a.n end, 0)")
_FOUND = (f"coalesce(case when {_COLLISION} then 'NPIs: ' || coalesce(v.npi_text, 'no NPI') else a.shown end, '')")


_G1 = dict(
    e=_entries_sql("multi", False),
    pk=f"select _ord as ro, unnest(keys) as k from ({_PEOPLE_KEYS})",
    mk="select _ord, unnest(keys) as k from (" + sql.fullname_variants("(select _ord, full_name from m)", "full_name", 3) + ")",
    met="select distinct mk._ord, e.npi, e.mid, e.raw, e.nk, e.pos from mk join pk using (k) join e using (ro) where k <> ''",
    v=_PEOPLE_VERDICT,
    s="select _ord, raw, min(pos) as pos, arg_min(nk, pos) as nk from met group by 1, 2",
    a="select _ord, count(*) as n, count(distinct nk) as norms, string_agg(raw, ' | ' order by pos) as shown from s group by 1",
)


def _judged(spark, sf_dir):
    sets = [(*_A1, None), (*_A2, None)]
    return classifying.address_status(
        board(spark, sf_dir), people(spark, sf_dir), names.fullname_variants("full_name", 3),
        names.name_variants("last_name", "first_name"), sets)


@query("g1_address_status", sql.with_inputs(
    "p m",
    f"select m._ord, case when v._ord is null then 'not_in_originals' {_COMMON} when a.norms = 1 then 'same_address_variant' else 'multiple_addresses' end as address_status, "
    f"cast({_COUNT} as integer) as address_count, {_FOUND} as addresses_found from m left join v on v._ord = m._ord left join a on a._ord = m._ord", **_G1))
def _status(spark, sf_dir):
    return _judged(spark, sf_dir).select("_ord", "address_status", "address_count", "addresses_found")


@query("g2_address_status_round2", sql.with_inputs(
    "p m",
    f"select m._ord, case when v._ord is null then 'not_in_gold' {_COMMON} else 'multiple_addresses' end as address_status, "
    f"cast({_COUNT} as integer) as address_count, {_FOUND} as addresses_found, case when v._ord is null then 'none' when m.npi <> '' and m.npi in (select npi from e) then 'npi' "
    "else 'name' end as _match_method from m left join v on v._ord = m._ord left join a on a._ord = m._ord",
    e=_entries_sql("round2", True),
    pk=f"select _ord as ro, unnest(keys) as k from ({_PEOPLE_KEYS})",
    mk="select _ord, unnest(keys) as k from (select _ord, keys from (" + mq.fq.round2_keys_sql("(select _ord, first_name, full_name from m)", "first_name", "full_name") + "))",
    met="select distinct m._ord, e.npi, e.mid, e.raw, e.nk, e.pos from m join e on e.npi = m.npi where m.npi <> '' union all "
        "select distinct mk._ord, e.npi, e.mid, e.raw, e.nk, e.pos from mk join pk using (k) join e using (ro) join m on m._ord = mk._ord "
        "where k <> '' and not (m.npi <> '' and m.npi in (select npi from e))",
    v=_PEOPLE_VERDICT,
    s="select _ord, nk, min(pos) as pos, arg_min(raw, -length(raw) * 1000000000 + pos) as raw from met group by 1, 2",
    a="select _ord, count(*) as n, string_agg(raw, ' | ' order by pos) as shown from s group by 1"))
def _status2(spark, sf_dir):
    sets = [(*_A1, "primary_state"), (*_A2, None)]
    done = classifying.address_status_round2(
        board(spark, sf_dir), people(spark, sf_dir), "npi", names.round2_name_keys("first_name", "full_name"),
        names.name_variants("last_name", "first_name"), sets)
    return done.select("_ord", "address_status", "address_count", "addresses_found", "_match_method")


# F4 takes up the rows that G1 found to have several addresses
_SEVERAL = f"from m join v on v._ord = m._ord join a on a._ord = m._ord where not {_COLLISION} and a.n > 1 and a.norms > 1"
_NTH = "(select * from (select *, row_number() over (partition by _ord order by pos) as slot from s) where slot = {n} and _ord = m._ord)"


def _gold(n: int) -> str:
    raw = f"(select raw from {_NTH.format(n=n)})"
    return ", ".join(f"trim(coalesce(split_part({raw}, '|', {i}), '')) as gold_{part}_{n}" for i, part in enumerate(("addr", "city", "zip"), 1))


@query("f4_addresses_compare", sql.with_inputs(
    "p m", f"select m._ord, m.primary_address_1 as mail_address, m.primary_city as mail_city, m.zip5 as mail_zip, cast(a.n as integer) as num_addresses, {_gold(1)}, {_gold(2)}, {_gold(3)} {_SEVERAL}", **_G1))
def _compare(spark, sf_dir):
    return reporting.addresses_compare(_judged(spark, sf_dir), ["_ord"], "primary_address_1", "primary_city", "zip5", slots=3)


@query("f4_found_addresses", sql.with_inputs(
    "p m", "select s._ord, cast(row_number() over (partition by s._ord order by s.pos) as integer) as slot, split_part(s.raw, '|', 1) as addr, split_part(s.raw, '|', 2) as city, "
    f"split_part(s.raw, '|', 3) as zip from s where s._ord in (select m._ord {_SEVERAL})", **_G1))
def _found(spark, sf_dir):
    return reporting.found_addresses(_judged(spark, sf_dir), ["_ord"])


# --- G3 to G7 ----------------------------------------------------------------------------------


@query("g3_match_quality", sql.with_inputs(
    "p m", "select _ord, ro, case when a <> '' and b <> '' then case when a = b then 'exact' else 'suspect_middle' end when a = '' and b = '' then 'no_middle_either_side' "
    f"else 'one_side_missing_middle' end as match_quality from (select p._ord, m._ord as ro, substr({sql.norm('p.middle_name')}, 1, 1) as a, substr({sql.norm('m.middle_name')}, 1, 1) as b "
    "from p join m on p.npi = m.npi where p.npi <> '')"))
def _quality(spark, sf_dir):
    left = people(spark, sf_dir).where("npi <> ''").select("npi", "_ord", "middle_name")
    right = board(spark, sf_dir).where("npi <> ''").select("npi", F.col("_ord").alias("ro"), F.col("middle_name").alias("m2"))
    return left.join(right, "npi").select("_ord", "ro", comparing.match_quality("middle_name", "m2").alias("match_quality"))


_STACK = (f"select 'NPI' as st, _ord, {mq._NK} as nk, {sql.zip5('zip5')} as z, {sql.zip5('mailing_postal_code')} as mz, credential, '' as license_type_desc from p union all "
          f"select 'MN', _ord, {mq._NK}, {sql.zip5('zip5')}, '', '', license_type_desc from m")
_AGREE = ("select x.*, case when st <> 'MN' or z = '' then '' when exists (select 1 from t y where y.st = 'NPI' and y.nk = x.nk and y.z = x.z) then 'matches_npi_primary_zip' "
          "when exists (select 1 from t y where y.st = 'NPI' and y.nk = x.nk and y.mz = x.z) then 'matches_npi_mailing_zip' else '' end as agree from t x")


def _stacked(spark, sf_dir):
    key = names.name_key("last_name", "first_name")
    left = people(spark, sf_dir).withColumns({"_source_type": F.lit("NPI"), "_name_key": key})
    right = board(spark, sf_dir).withColumns({"_source_type": F.lit("MN"), "_name_key": key})
    return left.unionByName(right, allowMissingColumns=True)


@query("g4_zip_agreement", sql.with_inputs(
    "p m", "select st as _source_type, _ord, nk as _name_key, agree as _npi_address_match from ag", t=_STACK, ag=_AGREE))
def _agreement(spark, sf_dir):
    return comparing.zip_agreement(_stacked(spark, sf_dir)).select("_source_type", "_ord", "_name_key", "_npi_address_match")


@query("g5_disambiguate", sql.with_inputs(
    "p m",
    "select st as _source_type, _ord, case when st = 'NPI' or cats is null then 'unclear' when agree <> '' then 'same_person_zip_match' "
    "when own <> '' and list_contains(cats, own) then 'same_person_credential_match' when len(list_filter(cats, lambda c: c <> '')) > 0 then 'likely_different_person' "
    f"else 'unclear' end as _person_status from (select *, {sql.credential('license_type_desc')} as own from ag) left join c using (nk)",
    t=_STACK, ag=_AGREE, c=f"select nk, list(distinct {sql.credential('credential')}) as cats from t where st = 'NPI' group by nk"))
def _disambiguate(spark, sf_dir):
    rows = comparing.zip_agreement(_stacked(spark, sf_dir))
    return comparing.disambiguate(rows).select("_source_type", "_ord", "_person_status")


PATTERNS = [(r"\bpromo\b", "Promo Health", "Edina"), (r"\b1st rd\b", "First Road Center", "Anoka")]
_OVERRIDES = ("select 'Override ' || c_mktsegment as label, 'City ' || c_nationkey as city, cast(c_nationkey * 10 as string) || ' economy st.' as address, c_custkey from customer")
_ORG = (f"regexp_matches({{0}}, '^[a-zA-Z]') and not regexp_matches({{0}}, '(?i){fv.PO_BOX}') and not regexp_matches({{0}}, '(?i)^(?:{'|'.join(fv.NOT_A_LABEL)})')")


@query("g6_assign_label", sql.with_inputs(
    "p m",
    f"select m._ord, case when trim(m.health_system) <> '' then m.health_system when o.label is not null then o.label "
    + " ".join(f"when regexp_matches(a1, '(?i){p}') then '{label}'" for p, label, _ in PATTERNS)
    + f" when {_ORG.format('a1')} then a1 when {_ORG.format('a2')} then a2 when r.ref_label is not null then r.ref_label else m.health_system end as health_system, "
    "case when trim(m.health_system) <> '' then m.health_system_city when o.label is not null then o.city "
    + " ".join(f"when regexp_matches(a1, '(?i){p}') then '{city}'" for p, _, city in PATTERNS)
    + f" when {_ORG.format('a1')} or {_ORG.format('a2')} then trim(m.primary_city) when r.ref_label is not null then coalesce(nullif(r.ref_city, ''), trim(m.primary_city)) "
    "else m.health_system_city end as health_system_city from (select *, trim(primary_address_1) as a1, trim(primary_address_2) as a2 from m) m "
    f"left join o on o.address = {sql.norm('a1')} left join r on r.key = {sql.norm('a1')}",
    ov=_OVERRIDES, o=f"select {sql.norm('address')} as address, min((label, city)) as best, best[1] as label, best[2] as city from ov group by 1",
    r=f"select {sql.norm('primary_address_1')} as key, arg_min('Ref ' || source_tab, _ord) as ref_label, arg_min(case when _ord % 2 = 0 then '' else trim(primary_city) end, _ord) as ref_city from p group by 1"))
def _assign(spark, sf_dir):
    from rollbook.plans.inputs import table

    overrides = table(spark, sf_dir, "customer").selectExpr(
        "'Override ' || c_mktsegment as label", "'City ' || c_nationkey as city", "cast(c_nationkey * 10 as string) || ' economy st.' as address")
    known = people(spark, sf_dir).withColumns({
        "health_system": F.concat(F.lit("Ref "), "source_tab"),
        "health_system_city": F.when(F.col("_ord") % 2 == 0, "").otherwise(F.col("primary_city"))})
    reference = labelling.label_reference([known], ["primary_address_1"])
    done = labelling.assign_label(
        board(spark, sf_dir), overrides, PATTERNS, reference, "primary_address_1", "primary_address_2", None, "primary_city")
    return done.select("_ord", labelling.LABEL, labelling.CITY)


@query("g7_clear_noise", sql.with_inputs(
    "m", f"select _ord, case when {_NOISE} and _ord % 3 <> 0 then '' else health_system end as health_system, "
    f"case when {_NOISE} and _ord % 3 <> 0 then '' else health_system_city end as health_system_city from m"))
def _noise(spark, sf_dir):
    rows = board(spark, sf_dir).withColumn("_user_reviewed", F.when(F.col("_ord") % 3 == 0, "yes").otherwise(""))
    return labelling.clear_noise(rows).select("_ord", labelling.LABEL, labelling.CITY)


@query("g7_flag_likely_clinic", sql.with_inputs(
    "m", f"select _ord, case when health_system in ('Solo Practice', 'Group Practice') and regexp_matches({sql.known('primary_address_2')}, '(?i){fv.UNIT_MARK}') "
    f"then 'suite_address' else '' end as generic_flag, case when trim(health_system) = '' and regexp_matches({sql.known('primary_address_2')}, '(?i){fv.UNIT_MARK}') "
    "then 'likely_clinic' else '' end as open_flag from m"))
def _likely(spark, sf_dir):
    rows = labelling.flag_likely_clinic(board(spark, sf_dir), "primary_address_2", out="generic_flag")
    return labelling.flag_likely_clinic(rows, "primary_address_2", generic=False, out="open_flag").select("_ord", "generic_flag", "open_flag")
