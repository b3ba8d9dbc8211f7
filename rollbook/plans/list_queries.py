"""Cleaning, filtering and deduplication over the people and board tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.operators import cleaning, dedup
from rollbook.plans import sql
from rollbook.plans.inputs import BOARD, PEOPLE, board, people
from rollbook.scale import global_rank, stored

QUERIES = {}
SQL = {}

PEOPLE_COLUMNS = list(PEOPLE)
BOARD_COLUMNS = list(BOARD)


def query(name: str, expected: str | None = None):
    def add(f):
        QUERIES[name] = f
        if expected:
            SQL[name] = expected
        return f

    return add


def cleaned_column(name: str) -> str:
    """SQL of one column after `normalise`."""
    if name == "_ord":
        return name
    if name in fv.TITLE_CASED_COLUMNS:
        return f"{sql.title(name)} as {name}"
    if "telephone" in name or "fax" in name:
        d = sql.digits(name)
        return (f"case when length({d}) = 10 then substr({d}, 1, 3) || '-' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4) "
                f"else {sql.strip(name)} end as {name}")
    return f"{sql.zip5(name)} as zip5" if name == "zip5" else f"{sql.strip(name)} as {name}"


CLEANED = "select " + ", ".join(cleaned_column(c) for c in PEOPLE_COLUMNS) + " from p"
_NK = f"{sql.norm_name('last_name')} || '|' || {sql.norm_name('first_name')}"


def _first_per(key: str, source: str, order: str = "_ord") -> str:
    return f"select * exclude (rn) from (select *, row_number() over (partition by {key} order by {order}) as rn from {source}) where rn = 1"


@query("c1_clean", sql.with_inputs(
    "p", _first_per("case when npi = '' then 'row' || _ord else npi end", "(select * from c where upper(status) = 'A')"), c=CLEANED))
def _clean(spark, sf_dir):
    return cleaning.clean(people(spark, sf_dir), active_only=True)


@query("c1_clean_blank_is_key", sql.with_inputs("p", _first_per("npi", "c"), c=CLEANED))
def _clean_blank(spark, sf_dir):
    return cleaning.clean(people(spark, sf_dir), blank_is_key=True)


for _mode, _key in (("name", _NK), ("name+zip", f"{_NK}, {sql.zip5('zip5')}"),
                    ("name+city", f"{_NK}, {sql.norm_name('primary_city')}")):
    QUERIES[f"c1_clean_{_mode.replace('+', '_')}"] = (
        lambda spark, sf_dir, mode=_mode: cleaning.clean(people(spark, sf_dir), dedup_on=mode))
    SQL[f"c1_clean_{_mode.replace('+', '_')}"] = sql.with_inputs("p", _first_per(_key, "c"), c=CLEANED)

ADDRESS_SETS = [
    ("primary_address_1", "primary_city", "zip5", "primary_state"), ("primary_address_2", "primary_city", "zip5", None),
]


@query("c2_restrict_states", sql.with_inputs(
    "p", "select _ord, addr, city, zip from (select _ord, trim(primary_address_1) as addr, trim(primary_city) as city, "
    "trim(zip5) as zip from p where lower(trim(primary_state)) in ('', 'mn', 'wi') union all "
    "select _ord, trim(primary_address_2), trim(primary_city), trim(zip5) from p) where addr <> ''"))
def _restrict(spark, sf_dir):
    rows = cleaning.restrict_states(people(spark, sf_dir), ADDRESS_SETS)
    return rows.select("_ord", F.explode("addresses").alias("a")).select("_ord", "a.addr", "a.city", "a.zip")


@query("c3_reorder", sql.with_inputs("p", "select * from p"))
def _reorder(spark, sf_dir):
    return cleaning.reorder(people(spark, sf_dir), ("npi", "zip5", "last_name"))


_SORT = "zip5, primary_city, primary_address_1, last_name, first_name, _ord"


@query("c4_sort_by_location", sql.with_inputs(
    "p", f"select _ord, zip5, row_number() over (order by {_SORT}) as position from p"))
def _sorted(spark, sf_dir):
    return _positions(cleaning.sort_by_location(people(spark, sf_dir))).select("_ord", "zip5", "position")


def _positions(ordered):
    """Rows with their place in the order in which they came: partitions of a sorted table follow each other."""
    placed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "positions")
    return global_rank(placed, [F.col("at")], "position")


@query("c4_sort_rows_ignore_case", sql.with_inputs(
    "p", "select _ord, last_name, first_name, row_number() over (order by lower(last_name), lower(first_name), _ord) as position from p"))
def _sorted_names(spark, sf_dir):
    rows = people(spark, sf_dir).select("_ord", "last_name", "first_name")
    return _positions(cleaning.sort_rows(rows, ["last_name", "first_name"], ignore_case=True)).drop("at")


# --- deduplication -----------------------------------------------------------------------------


@query("d1_dedup_first", sql.with_inputs("m", _first_per("last_name, first_name", "m")))
def _dedup_first(spark, sf_dir):
    return dedup.dedup_first(board(spark, sf_dir), ["last_name", "first_name"])


_DIFFS = ", ".join(f"case when d.{c} <> k.{c} then '{c}' end" for c in PEOPLE_COLUMNS if c not in ("npi", "_ord"))


@query("d2_dropped_report", sql.with_inputs(
    "p",
    f"select d.* exclude (rn), coalesce(nullif(array_to_string(list_filter([{_DIFFS}], lambda x: x is not null), ', '), ''), "
    "'(identical)') as _fields_differing_from_kept from r d join r k on d.npi = k.npi and k.rn = 1 where d.rn > 1",
    r="select *, row_number() over (partition by npi order by _ord) as rn from p where npi <> ''"))
def _dropped(spark, sf_dir):
    return dedup.dropped_report(people(spark, sf_dir), "npi")


@query("d3_flag_duplicates", sql.with_inputs(
    "p",
    "select p.*, k._name_key, k._dupe_count, coalesce(g._dupe_group, 0) as _dupe_group, coalesce(g.files, '') as _files_in_group, "
    "case when exists (select 1 from k o where o._name_key = k._name_key and o.source_file <> k.source_file and o.z = k.z "
    "and k.z <> '') then 'Y' else 'N' end as _zip_match from p join k on p._ord = k._ord left join g on g._name_key = k._name_key",
    k=f"select _ord, source_file, {sql.zip5('zip5')} as z, {_NK} as _name_key, count(*) over (partition by {_NK}) as _dupe_count from p",
    g="select _name_key, string_agg(distinct source_file, ', ' order by source_file) as files, "
      "row_number() over (order by _name_key) as _dupe_group from k where _dupe_count > 1 group by _name_key"))
def _flag(spark, sf_dir):
    return dedup.flag_duplicates(people(spark, sf_dir))


_PRIO = (
    "select *, case when regexp_full_match(trim(npi), '[0-9]{10}') then trim(npi) else "
    f"{sql.norm('last_name')} || '|' || {sql.norm('first_name')} || '|' || {sql.norm('middle_name')} || '|' || {sql.zip5('zip5')} end as key, "
    "regexp_full_match(trim(npi), '[0-9]{10}') as by_npi, case source_tab when 'matched' then 0 when 'npionly' then 1 "
    "when 'mnonly' then 2 else 99 end as t, case source_file when 'file1' then 0 when 'file0' then 1 else 99 end as f from p"
)
_PRIO_RANKED = "select *, row_number() over (partition by by_npi, key order by t, f, _ord) as rn from k"


def _priority(spark, sf_dir):
    return dedup.dedup_priority(
        people(spark, sf_dir), file_ranks={"file1": 0, "file0": 1}, tab="source_tab", file="source_file")


@query("d4_dedup_priority_kept", sql.with_inputs(
    "p", "select * exclude (key, by_npi, t, f, rn) from r where rn = 1 and key <> '|||'", k=_PRIO, r=_PRIO_RANKED))
def _priority_kept(spark, sf_dir):
    return _priority(spark, sf_dir)[0]


@query("d4_dedup_priority_removed", sql.with_inputs(
    "p", "select * exclude (key, by_npi, t, f, rn), case when by_npi then 'duplicate_npi' else 'duplicate_name_zip' end as _removed_by, "
    "case when by_npi then '' else key end as _dedup_key from r where rn > 1 or key = '|||'", k=_PRIO, r=_PRIO_RANKED))
def _priority_removed(spark, sf_dir):
    return _priority(spark, sf_dir)[1]


@query("d4_gold_addresses", sql.with_inputs(
    "p", "select _ord, trim(primary_address_1) as _addr1, trim(primary_address_2) as _addr2, trim(primary_city) as _city, "
    "trim(zip5) as _zip, trim(mailing_address_1) as _mail_addr, trim(mailing_city) as _mail_city, trim(mailing_postal_code) as _mail_zip from p"))
def _gold_addresses(spark, sf_dir):
    rows = dedup.add_gold_addresses(people(spark, sf_dir))
    return rows.select("_ord", "_addr1", "_addr2", "_city", "_zip", "_mail_addr", "_mail_city", "_mail_zip")


_T = sql.strip_suffix(sql.norm("full_name"))
_COUNTED = " + ".join(f"case when trim({c}) in ('', 'nan', 'NaN') then 0 else 1 end" for c in BOARD_COLUMNS if c != "_ord")
_COMPLETE = (
    f"select *, case when length({sql.digits('npi')}) = 10 then 'npi:' || {sql.digits('npi')} when l = '' then '' "
    f"else trim('name:' || l || ' ' || f) end as _dedup_key, cast({_COUNTED} as integer) as _field_count from "
    "(select *, case when trim(full_name) = '' then "
    f"{sql.norm('last_name')} when contains(t, ',') then trim(split_part(t, ',', 1)) else coalesce(w[-1], '') end as l, "
    f"case when trim(full_name) = '' then split_part({sql.norm('first_name')}, ' ', 1) when contains(t, ',') then "
    "split_part(trim(substr(t, strpos(t, ',') + 1)), ' ', 1) when len(w) >= 2 then w[1] else '' end as f from "
    f"(select *, {sql.word_list('t')} as w from (select *, {_T} as t from m)))"
)
_COMPLETE_RANKED = (
    "select * exclude (t, w, l, f), row_number() over (partition by case when _dedup_key = '' then 'row' || _ord else _dedup_key end "
    "order by _field_count desc, _ord) as rn from k"
)


def _complete(spark, sf_dir):
    return dedup.dedup_most_complete(board(spark, sf_dir), full="full_name")


@query("d5_dedup_most_complete_kept", sql.with_inputs(
    "m", "select * exclude (rn) from r where rn = 1", k=_COMPLETE, r=_COMPLETE_RANKED))
def _complete_kept(spark, sf_dir):
    return _complete(spark, sf_dir)[0]


@query("d5_dedup_most_complete_removed", sql.with_inputs(
    "m", "select * exclude (rn) from r where rn > 1", k=_COMPLETE, r=_COMPLETE_RANKED))
def _complete_removed(spark, sf_dir):
    return _complete(spark, sf_dir)[1]


def _token_key(last: str, first: str) -> str:
    return f"{sql.clean_name(last, True)} || '|' || split_part({sql.clean_name(first, True)}, ' ', 1)"


@query("d6_union_first", sql.with_inputs(
    "p m", "select last_name, first_name, source, _key from (select *, row_number() over (partition by _key order by rank, _ord) as rn "
    "from u where _key <> '|') where rn = 1",
    u=f"select 0 as rank, _ord, last_name, first_name, 'people' as source, {_token_key('last_name', 'first_name')} as _key from p "
      f"union all select 1, _ord, last_name, first_name, 'board', {_token_key('last_name', 'first_name')} from m"))
def _union_first(spark, sf_dir):
    return dedup.union_first([(people(spark, sf_dir), "people"), (board(spark, sf_dir), "board")])


@query("d7_duplicate_rows_npi", sql.with_inputs(
    "p", "select * from p where trim(npi) <> '' and npi in (select npi from p group by npi having count(*) > 1)"))
def _duplicate_npi(spark, sf_dir):
    return dedup.duplicate_rows(people(spark, sf_dir), "npi")


_PAIR = sql.strip_suffix(f"{sql.norm('last_name')} || '|' || {sql.norm('first_name')}")


@query("d7_duplicate_rows_name", sql.with_inputs(
    "p", "select * exclude (k, n) from (select *, count(*) over (partition by k) as n from k) where n > 1 and k <> '|'",
    k=f"select *, {_PAIR} as k from p"))
def _duplicate_name(spark, sf_dir):
    return dedup.duplicate_rows(people(spark, sf_dir), dedup.pair_key("last_name", "first_name"), "|")
