"""Consolidation, wide tables, overlaps, counts and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.addresses import parse_addresses
from rollbook.functions.names import first_token_key, name_addr_key
from rollbook.functions.text import as_column, filled, norm, strip, zip5
from rollbook.operators.cleaning import reorder
from rollbook.operators.dedup import whole_row
from rollbook.scale import global_rank, keyed_join, segmented, stored

# --- joining texts per key ---------------------------------------------------------------------


def joined_texts(df: DataFrame, key: str, fields: Sequence[str], order_by: str, sep: str = " | ") -> DataFrame:
    """Per key, each field's filled values joined in first-seen order, values equal but for case once.

    Values are made distinct per key and field before they are collected, so a group costs what its output holds.
    """
    stacked = df.select(
        as_column(key),
        as_column(order_by),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("field"), strip(c).alias("value")) for i, c in enumerate(fields)])
        ).alias("__f"),
    ).where("__f.value <> ''")
    distinct = stacked.groupBy(key, F.col("__f.field").alias("__field"), F.lower("__f.value").alias("__low")).agg(
        F.min(order_by).alias("__at"), F.min_by("__f.value", order_by).alias("__value")
    )

    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")
    texts = [f"listagg(__value, '{quoted}') within group (order by __at) filter (where __field = {i})" for i in range(len(fields))]
    return distinct.groupBy(key).agg(*[F.coalesce(F.expr(t), F.lit("")).alias(c) for t, c in zip(texts, fields)])


def _lone(key: Column, order_by: str, blank: Column, blank_is_key: bool) -> Column:
    """The key, or for rows whose key is blank one of their own, so a large nameless group never gathers."""
    return key if blank_is_key else F.when(blank, F.concat(F.lit("\u0001"), F.to_json(F.struct(order_by)))).otherwise(key)


def consolidate(
    df: DataFrame,
    key: Column | None = None,
    concat_fields: Sequence[str] = fv.LICENSE_TEXT_COLUMNS,
    order_by: str = "_ord",
    count: str = "_mn_specialty_count",
    yes_field: str = "discipined",
    blank_is_key: bool = True,
) -> DataFrame:
    """One row per name+address+ZIP: listed fields joined, 'Y' kept when any row has it, other fields first value.

    Rows that stand alone keep their raw values. With `blank_is_key=False` rows whose key has no letter or digit stay apart.
    """
    fields = [c for c in concat_fields if c in df.columns]
    key = key if key is not None else name_addr_key("last_name", "first_name", "primary_address_1", "zip5")
    rows = df.withColumn("__key", _lone(key, order_by, ~F.coalesce(key, F.lit("")).rlike(r"[\p{L}\p{N}]"), blank_is_key))
    aggs = [F.min_by(whole_row(df), order_by).alias("__row"), F.count(F.lit(1)).alias(count)]
    if yes_field in df.columns:
        aggs.append(F.max((F.upper(as_column(yes_field)) == "Y").cast("int")).alias("__yes"))
    firsts = rows.groupBy("__key").agg(*aggs)
    texts = joined_texts(rows, "__key", fields, order_by).select(
        "__key", F.struct(*[as_column(c) for c in fields]).alias("__texts")
    ) if fields else None
    both = firsts.join(texts, "__key", "left") if texts is not None else firsts

    def value(c: str) -> Column:
        raw = F.col("__row")[c]
        if c in fields:
            return F.when(F.col(count) > 1, F.coalesce(F.col("__texts")[c], F.lit(""))).otherwise(raw)
        if c == yes_field:
            return F.when((F.col(count) > 1) & (F.col("__yes") == 1), "Y").otherwise(raw)
        return raw

    return both.select(*[value(c).alias(c) for c in df.columns], F.col(count))


def filled_columns(tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[set[str]]:
    """Per table, which of the given columns have a filled value; one job for all, one row per table to the driver."""
    rows = None
    for n, (df, columns) in enumerate(tables):
        flags = [F.coalesce(F.max(strip(c) != ""), F.lit(False)) for c in columns]
        row = df.agg(F.lit(n).alias("table"), F.array(*flags).cast("array<boolean>").alias("filled"))
        rows = row if rows is None else rows.unionByName(row)
    found = {r["table"]: r["filled"] for r in rows.collect()}
    return [{c for c, full in zip(columns, found[n], strict=True) if full} for n, (_, columns) in enumerate(tables)]


def pivot_wide(
    left: DataFrame, right: DataFrame, key: str = "_name_key", order_by: str = "_ord", kind: str = "_match_type",
    blank_is_key: bool = True,
) -> DataFrame:
    """One row per name: registry columns renamed `npi_*`, board columns `mn_*`, board-only columns joined with ' | '.

    Board-only columns are those filled somewhere on the right and nowhere on the left; finding them takes one small job. With
    `blank_is_key=False` rows without a name stay rows of their own, and the board's nameless rows join nothing.
    """
    if not blank_is_key:
        nameless = ~filled(key).rlike(r"[\p{L}\p{N}]")
        left = left.withColumn(key, _lone(as_column(key), order_by, nameless, False))
        right = right.where(~nameless)
    internal = {key, order_by, "_match_key", "_npi_count", "_mn_count", "_source_type"}
    own = {"last_name", "first_name", "middle_name"}
    candidates = [c for c in right.columns if c not in internal | own]
    right_filled, left_filled = filled_columns([(right, candidates), (left, [c for c in left.columns if c not in internal])])
    board_only = [c for c in candidates if c in right_filled and c not in left_filled]

    # last mapping wins when two source columns share a wide name
    left_names: dict[str, str] = {}
    for c in left.columns:
        if c not in internal and c not in board_only:
            left_names[fv.REGISTRY_WIDE_NAMES.get(c, c)] = c
    firsts = left.groupBy(key).agg(
        F.min_by(F.struct(*[as_column(c).alias(n) for n, c in left_names.items()]), order_by).alias("__row")
    )
    taken = dict.fromkeys(
        [c for c in fv.BOARD_WIDE_NAMES if c in right.columns] + board_only + ([kind] if kind in right.columns else [])
    )
    right_names = {fv.BOARD_WIDE_NAMES.get(c, c): c for c in taken}
    renamed = right.select(key, order_by, *[as_column(c).alias(n) for n, c in right_names.items()])
    texts = joined_texts(renamed, key, list(right_names), order_by)
    extra = [n for n in right_names if n not in left_names]
    wide = firsts.join(texts, key, "left").select(
        *[F.col("__row")[n].alias(n) for n in left_names],
        *[F.coalesce(as_column(n), F.lit("")).alias(n) for n in extra],
    )
    return reorder(wide, fv.WIDE_ORDER)


# --- several addresses per person --------------------------------------------------------------


def _addressed(df: DataFrame, last: str, first: str, addr: str, city: str, zip_: str, order_by: str, blank_is_key: bool) -> DataFrame:
    """Rows with the person (`__who`) and the address as it is compared (`__a`, `__c`, `__z`)."""
    key = first_token_key(last, first)
    lone = F.lit("") if blank_is_key else F.when(key == "|", F.to_json(F.struct(order_by))).otherwise("")
    rows = df.withColumn("_norm_key", key).withColumn("__who", F.concat_ws("\u0001", key, lone))
    return rows.withColumns({"__a": norm(addr), "__c": norm(city), "__z": zip5(zip_)})


def _slots(rows: DataFrame, addr: str, city: str, zip_: str, order_by: str) -> DataFrame:
    """(__who, __a, __c, __z, at, address, city, zip, slot): the different addresses of each person, numbered from 1 in the order
    in which they first occur; a person of any number of addresses is numbered over as many segments as needed."""
    raw = F.struct(filled(addr).alias("address"), filled(city).alias("city"), filled(zip_).alias("zip"))
    each = rows.groupBy("__who", "__a", "__c", "__z").agg(F.min(order_by).alias("at"), F.min_by(raw, order_by).alias("raw"))
    return stored(segmented(each.select("__who", "__a", "__c", "__z", "at", "raw.*"), ["__who"], [F.asc("at")], "slot"), "slots")


def address_slots(
    df: DataFrame, last: str = "last_name", first: str = "first_name", addr: str = "primary_address_1", city: str = "primary_city",
    zip_: str = "zip5", order_by: str = "_ord", blank_is_key: bool = False,
) -> DataFrame:
    """(person, slot, at, address, city, zip): the long form of the addresses of each person.

    `person` is the order value of the person's first row, `at` that of the address's first row.
    """
    slots = _slots(_addressed(df, last, first, addr, city, zip_, order_by, blank_is_key), addr, city, zip_, order_by)
    people = slots.where("slot = 1").select("__who", F.col("at").alias("person"))
    return keyed_join(slots, people, ["__who"], "inner").select("person", F.col("slot").cast("int").alias("slot"), "at", "address", "city", "zip")


def addresses_wide(
    df: DataFrame,
    last: str = "last_name",
    first: str = "first_name",
    addr: str = "primary_address_1",
    city: str = "primary_city",
    zip_: str = "zip5",
    order_by: str = "_ord",
    blank_is_key: bool = False,
    *,
    slots: int,
) -> tuple[DataFrame, DataFrame]:
    """(wide, dropped): one row per person with num_addresses and the first `slots` addresses as address_n, city_n, zip_n.

    All addresses of a person are in `address_slots`. An address repeated for the same person is dropped and logged with
    everything seen before it; a blank address takes one slot. Nameless rows stay apart unless `blank_is_key`.
    """
    rows = _addressed(df, last, first, addr, city, zip_, order_by, blank_is_key)
    found = _slots(rows, addr, city, zip_, order_by)
    base = [c for c in df.columns if c not in (addr, city, zip_)] + ["_norm_key"]
    people = rows.groupBy("__who").agg(F.min_by(F.struct(*[as_column(c) for c in base]), order_by).alias("__row"))
    numbers = found.groupBy("__who").agg(
        F.max("slot").cast("int").alias("num_addresses"),
        *[F.max(F.when(F.col("slot") == i, F.col(part))).alias(f"{part}_{i}") for i in range(1, slots + 1) for part in ("address", "city", "zip")],
    )
    filled_slots = [F.coalesce(f"{part}_{i}", F.lit("")).alias(f"{part}_{i}") for i in range(1, slots + 1) for part in ("address", "city", "zip")]
    wide = people.join(numbers, "__who").select(*[F.col("__row")[c].alias(c) for c in base], "num_addresses", *filled_slots)
    same = ["__who", "__a", "__c", "__z"]
    repeated = keyed_join(rows.where("__a <> ''"), found.select(*same, F.col("at").alias("__at")), same, "inner")
    repeated = repeated.where(F.col("__at") != as_column(order_by))
    # what was seen is only gathered for people with a repeated address; the log shows all of it
    seen = keyed_join(found, repeated.select("__who").distinct(), ["__who"], "left_semi").groupBy("__who").agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat_ws("|", "__a", "__c", "__z").alias("key")))).alias("__seen")
    )
    earlier = F.filter("__seen", lambda s: s["at"] < as_column(order_by))
    dropped = keyed_join(repeated, seen, ["__who"], "inner").select(
        as_column(last), as_column(first), filled(addr).alias("dup_address"), filled(city).alias("dup_city"),
        filled(zip_).alias("dup_zip"), F.col("__a").alias("norm_addr"), F.col("__c").alias("norm_city"),
        F.col("__z").alias("norm_zip"), F.array_join(F.transform(earlier, lambda s: s["key"]), " || ").alias("all_seen"),
    )
    return wide, dropped


def found_addresses(
    df: DataFrame, keep: Sequence[str], found: str = "addresses_found", status: str = "address_status"
) -> DataFrame:
    """(keep, slot, addr, city, zip): the long form of the addresses found for rows with several."""
    rows = df.where(F.col(status) == "multiple_addresses").select(*keep, F.posexplode(parse_addresses(found)).alias("slot", "a"))
    return rows.select(*keep, (F.col("slot") + 1).alias("slot"), "a.*")


def addresses_compare(
    df: DataFrame, keep: Sequence[str], addr: str, city: str, zip_: str, found: str = "addresses_found",
    status: str = "address_status", *, slots: int,
) -> DataFrame:
    """The mailing address beside the first `slots` of gold_addr_n, gold_city_n, gold_zip_n for rows with several addresses,
    and how many there are; `found_addresses` has all."""
    rows = df.where(F.col(status) == "multiple_addresses").withColumn("__parsed", parse_addresses(found))
    return rows.select(
        *[as_column(c) for c in keep],
        filled(addr).alias("mail_address"),
        filled(city).alias("mail_city"),
        filled(zip_).alias("mail_zip"),
        F.size("__parsed").alias("num_addresses"),
        *[
            F.coalesce(F.get("__parsed", F.lit(i))[part], F.lit("")).alias(f"gold_{part}_{i + 1}")
            for i in range(slots)
            for part in ("addr", "city", "zip")
        ],
    )


def reconcile(df: DataFrame, wide: DataFrame, dropped: DataFrame, slot: str = "num_addresses") -> DataFrame:
    """One row: input rows, people, extra address slots, dropped rows, and what stays unexplained."""
    names = ("input_rows", "unique_rows", "extra_slots", "dropped_rows")

    def part(frame: DataFrame, **aggs: Column) -> DataFrame:
        one = frame.agg(*[e.alias(n) for n, e in aggs.items()])
        return one.select(*[F.coalesce(n, F.lit(0)).alias(n) if n in aggs else F.lit(0).alias(n) for n in names])

    n = F.count(F.lit(1))
    parts = part(df, input_rows=n).unionByName(part(wide, unique_rows=n, extra_slots=F.sum(F.col(slot) - 1)))
    counts = parts.unionByName(part(dropped, dropped_rows=n)).agg(*[F.sum(c).alias(c) for c in names])
    total = F.col("unique_rows") + F.col("extra_slots") + F.col("dropped_rows")
    return counts.withColumns({"accounted": total, "difference": F.col("input_rows") - total})


# --- overlaps and counts -----------------------------------------------------------------------


def identifiers(df: DataFrame, npi: str, last: str, first: str, middle: str, source: str) -> DataFrame:
    """(match_type, identifier, source): the NPI when filled, else last|first|middle initial."""
    number = norm(npi)
    name = F.concat_ws("|", norm(last), norm(first), F.substring(norm(middle), 1, 1))
    by_npi = ~number.isin("", "nan")
    ids = df.select(
        F.when(by_npi, "npi").otherwise("name").alias("match_type"),
        F.when(by_npi, number).otherwise(name).alias("identifier"),
        filled(source).alias("source"),
    )
    return ids.where("identifier <> '||'")


def overlap_matrix(ids: DataFrame, zeros: bool = False) -> DataFrame:
    """Shared identifiers per pair of sources, by NPI and by name.

    Identifiers are first counted per set of sources, so pairs are formed only from sets that occur, and not over rows.
    With `zeros` every other pair of sources is listed too, with 0; that table grows with the square of the sources.
    """
    sets = (
        ids.groupBy("match_type", "identifier")
        .agg(F.array_sort(F.collect_set("source")).alias("sources"))
        .groupBy("match_type", "sources")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    def pairs(df: DataFrame, *keep: str) -> DataFrame:
        one = df.select(*keep, "sources", F.posexplode("sources").alias("at", "file_1"))
        later = F.slice("sources", F.col("at") + 2, F.size("sources"))
        return one.select(*keep, "file_1", F.explode(later).alias("file_2"))

    shared = pairs(sets.where(F.size("sources") > 1), "match_type", "n").groupBy("file_1", "file_2").agg(
        F.sum(F.when(F.col("match_type") == "npi", F.col("n")).otherwise(0)).alias("shared_by_npi"),
        F.sum(F.when(F.col("match_type") == "name", F.col("n")).otherwise(0)).alias("shared_by_name"),
    )
    counts = shared
    if zeros:
        every = ids.agg(F.array_sort(F.collect_set("source")).alias("sources"))
        counts = pairs(every).join(shared, ["file_1", "file_2"], "left").fillna(0)
    return counts.withColumn("total_shared", F.col("shared_by_npi") + F.col("shared_by_name"))


def overlap_details(ids: DataFrame, tab_sep: str = " / ") -> DataFrame:
    """Identifiers found in more than one file, with their files and sources."""
    per_id = (
        ids.groupBy("match_type", "identifier")
        .agg(F.array_sort(F.collect_set("source")).alias("sources"))
        .withColumn(
            "files",
            F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.substring_index(s, tab_sep, 1)))),
        )
        .where(F.size("files") > 1)
    )
    parts = F.split("identifier", r"\|")

    def part(i: int, name: str) -> Column:
        text = F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        return F.when(F.col("match_type") == "name", text).otherwise("").alias(name)

    return per_id.select(
        "match_type", "identifier", part(0, "last"), part(1, "first"), part(2, "middle_initial"),
        F.array_join("files", " | ").alias("files"), F.array_join("sources", " | ").alias("sources"),
    )


def value_counts(df: DataFrame, cols: Sequence[str], count: str = "n") -> DataFrame:
    """Rows per combination of values, most frequent first, ties by value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), *cols)


def source_breakdown(df: DataFrame, file: str = "_source_file", tab: str = "_source_tab") -> DataFrame:
    return value_counts(df, [file, tab], "row_count")


def rank_labels(
    df: DataFrame, label: str = "health_system", city: str = "health_system_city"
) -> tuple[DataFrame, DataFrame]:
    """(ranked, by_city): totals per label with 'city (n), ...' and a 1-based rank, and counts per label and city."""
    rows = df.where(filled(label) != "")
    by_city = rows.groupBy(filled(label).alias("health_system"), filled(city).alias("city")).agg(
        F.count(F.lit(1)).alias("providers")
    )
    entry = F.struct((-F.col("providers")).alias("order"), F.col("city"))
    shown = F.concat(
        F.lit(""), F.array_join(
            F.transform(
                F.array_sort(F.collect_list(entry)),
                lambda e: F.concat(
                    F.when(e["city"] == "", "(unknown)").otherwise(e["city"]), F.lit(" ("), -e["order"], F.lit(")")
                ),
            ),
            ", ",
        ),
    )
    totals = by_city.groupBy("health_system").agg(F.sum("providers").alias("total_providers"), shown.alias("cities"))
    ranked = global_rank(totals, [F.desc("total_providers"), F.col("health_system")], "rank")
    return ranked, by_city


def label_set_compare(
    a: DataFrame, b: DataFrame, cols: Sequence[tuple[str, str]], count_a: str = "a_providers", count_b: str = "b_providers"
) -> DataFrame:
    """Counts of each label on both sides with status only_in_a, only_in_b or in_both.

    `cols` pairs a column of `a` with one of `b`; give the label alone or label and city. Blank labels are ignored.
    """

    def counts(df: DataFrame, names: list[str], count: str) -> DataFrame:
        keys = [norm(n).alias(out) for n, (out, _) in zip(names, cols)]
        return df.select(*keys).where(F.col(cols[0][0]) != "").groupBy(*[c for c, _ in cols]).agg(
            F.count(F.lit(1)).alias(count)
        )

    both = counts(a, [x for x, _ in cols], count_a).join(
        counts(b, [y for _, y in cols], count_b), [x for x, _ in cols], "full"
    )
    status = (
        F.when(F.col(count_b).isNull(), "only_in_a").when(F.col(count_a).isNull(), "only_in_b").otherwise("in_both")
    )
    return both.withColumn("status", status).fillna(0, [count_a, count_b])


def profile(df: DataFrame, order_by: str = "_ord", limit: int = 60) -> DataFrame:
    """Per column the row count and the first filled example, cut to `limit` characters."""
    columns = [c for c in df.columns if c != order_by]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        shown = filled(c)
        aggs.append(F.min_by(shown, F.when(strip(c) != "", as_column(order_by))).alias(f"c{i}"))
    one = df.agg(*aggs)
    listed = F.array(
        *[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("example")) for i, c in enumerate(columns)]
    )
    rows = one.select("rows", F.explode(listed).alias("c")).select("c.position", "c.column", "rows", "c.example")
    cut = F.when(F.length("example") > limit, F.concat(F.substring("example", 1, limit - 3), F.lit("...")))
    return rows.withColumn("example", F.coalesce(cut, F.col("example"), F.lit("(empty)")))


def check_counts(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One (check, count) row per named table."""
    stacked = None
    for name, df in checks.items():
        part = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("check"), "count")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def check_summary(df: DataFrame, by: str, flag: str) -> DataFrame:
    """total, in and out per value of `by`, most missing first."""
    inside = F.col(flag).cast("int")
    return (
        df.groupBy(as_column(by).alias("source_tab"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(inside).alias("in_mailed"),
            F.sum(1 - inside).alias("not_in_mailed"),
        )
        .orderBy(F.desc("not_in_mailed"), "source_tab")
    )


def flag_breakdown(df: DataFrame, flags: str, sep: str = "|") -> DataFrame:
    """Rows per single flag of a delimited flag column, most frequent first."""
    single = df.select(F.explode(F.split(filled(flags), F.lit("\\Q" + sep + "\\E"))).alias("flag"))
    return value_counts(single.select(F.trim("flag").alias("flag")).where("flag <> ''"), ["flag"])
