"""Organisation labels: assigning, spreading over shared addresses, cleaning and summarising them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.addresses import base_addr_key, is_po_box
from rollbook.functions.labels import is_bad_label, is_individual_label, is_org_name, place_label
from rollbook.functions.names import parse_full_name, strip_suffix
from rollbook.functions.text import as_column, filled, known, let, norm, strip, title_case
from rollbook.operators.matching import attach_first, lookup_first
from rollbook.scale import keyed_join
from rollbook.sources.columns import resolve

LABEL = "health_system"
CITY = "health_system_city"


def with_label_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in (LABEL, CITY) if c not in df.columns})


def unlabelled() -> Column:
    return norm(LABEL) == ""


def label_reference(
    tables: Sequence[DataFrame], address_columns: Sequence[str], label: str = LABEL, city: str = CITY, order_by: str = "_ord"
) -> DataFrame:
    """(key, label, city, order) rows from labelled tables: tables in order, then address columns, then rows."""
    stacked = None
    for t, df in enumerate(tables):
        columns = [c for c in (resolve(df, [a]) for a in address_columns) if c]
        entries = F.array(*[F.struct(F.lit(i).alias("column"), norm(c).alias("key")) for i, c in enumerate(columns)])
        part = df.where(known(label) != "").select(
            known(label).alias("ref_label"), (strip(city) if city in df.columns else F.lit("")).alias("ref_city"),
            F.explode(entries).alias("e"), as_column(order_by).alias("row"),
        )
        part = part.select(
            "e.key", "ref_label", "ref_city",
            F.struct(F.lit(t).alias("table"), F.col("e.column").alias("column"), F.col("row")).alias("ref_order"),
        ).where("key <> ''")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def assign_label(
    df: DataFrame,
    overrides: DataFrame | None,
    patterns: Sequence[tuple[str, str, str]],
    reference: DataFrame | None,
    addr1: str,
    addr2: str | None = None,
    addr3: str | None = None,
    city: str | None = None,
    order_by: str = "_ord",
    organisations: bool = True,
) -> DataFrame:
    """Label the unlabelled rows, first hit wins.

    1 exact override of address 1 (table: address, label, city)   2 override patterns on address 1, and on address 2
    when address 1 is a department   3 address 1 as an organisation, then address 2, then address 3
    4 reference table by address 1, 2, 3. `organisations=False` runs the overrides only.
    """
    rows = with_label_columns(df).withColumns(
        {f"__a{i}": known(c) if c else F.lit("") for i, c in enumerate((addr1, addr2, addr3), 1)}
    )
    a1, a2, a3 = F.col("__a1"), F.col("__a2"), F.col("__a3")
    own_city = known(city) if city else F.lit("")
    empty = F.lit(None).cast("struct<label:string,city:string>")

    def hit(label: Column, place: Column) -> Column:
        return F.struct(label.alias("label"), place.alias("city"))

    candidates = []
    if overrides is not None:
        table = overrides.select(
            norm("address").alias("__address"),
            F.struct(F.col("label").alias("label"), F.col("city").alias("city")).alias("__override"),
        ).where("__address <> ''")
        table = table.groupBy("__address").agg(F.min("__override").alias("__override"))
        rows = keyed_join(rows.withColumn("__address", F.nullif(norm(a1), F.lit(""))), table, ["__address"])
        candidates.append(F.col("__override"))
    department = a1.rlike("(?iU)" + fv.DEPARTMENT_LINE)
    by_pattern = empty
    for pattern, label, place in reversed(patterns):
        found = a1.rlike("(?iU)" + pattern) | (department & a2.rlike("(?iU)" + pattern))
        by_pattern = F.when(found, hit(F.lit(label), F.lit(place))).otherwise(by_pattern)
    candidates.append(by_pattern)
    if organisations:
        candidates += [F.when(is_org_name(a), hit(a, own_city)) for a in (a1, a2, a3)]
    if reference is not None and organisations:
        keys = F.array(norm(a1), norm(a2), norm(a3))
        rows = lookup_first(
            rows, reference, keys, F.array("key"), ["ref_label", "ref_city"], order_by, "ref_order", "__ref"
        )
        place = F.coalesce(F.nullif(F.col("__ref.ref_city"), F.lit("")), own_city)
        candidates.append(F.when(F.col("__ref").isNotNull(), hit(F.col("__ref.ref_label"), place)))
    best = F.when(unlabelled(), F.coalesce(*candidates, empty))
    columns = [c for c in with_label_columns(df).columns if c not in (LABEL, CITY)]
    return rows.withColumn("__best", best).select(
        *[as_column(c) for c in columns],
        F.coalesce("__best.label", filled(LABEL)).alias(LABEL),
        F.coalesce("__best.city", filled(CITY)).alias(CITY),
    )


# --- places ------------------------------------------------------------------------------------


def name_query(
    last: str | None, first: str | None, full: str | None, city: str | None, state: str | None, specialty: str | None,
    default_state: str = "MN",
) -> Column:
    """Search text of a person: first, last, up to three words of specialty, city, state, "physician"; '' if nameless."""
    def text(c: str | None, default: str = "") -> Column:
        return known(c) if c else F.lit(default)

    words = F.substring_index(F.regexp_replace(text(specialty), r"(?U)\s+", " "), " ", 3)

    def query(l: Column, f: Column) -> Column:
        parts = [f, l, words, text(city), text(state, default_state)]
        joined = F.concat_ws(" ", *[F.when(p != "", p) for p in parts], F.lit("physician"))
        return F.when(l == "", "").otherwise(joined)

    def from_full(whole: Column) -> Column:
        given = F.substring_index(strip_suffix(F.substr(whole, F.instr(whole, ",") + 1)), " ", 1)
        surname = strip_suffix(F.substring_index(whole, ",", 1))
        with_comma = F.struct(surname.alias("last"), given.alias("first"), F.lit("").alias("middle"))
        return F.when(F.instr(whole, ",") > 0, with_comma).otherwise(parse_full_name(whole))

    own = F.struct(text(last).alias("last"), text(first).alias("first"), F.lit("").alias("middle"))
    name = own if not full else F.when(text(last) != "", own).otherwise(let(known(full), from_full))
    return let(name, lambda x: query(x["last"], x["first"]))


def address_query(addr: str, city: str, zip_: str) -> Column:
    """Search text of an address; PO boxes ask for a clinic in the place."""
    a, c, z = strip(addr), strip(city), strip(zip_)
    return F.when(is_po_box(a), F.concat_ws(" ", F.lit("clinic hospital"), c, z)).otherwise(F.concat_ws(" ", a, c, z))


def enrich_places(
    df: DataFrame, places: DataFrame, query: Column, city: str, order_by: str = "_ord", place_order: str = "query_key",
    per: Column | None = None,
) -> DataFrame:
    """Label the unlabelled rows from a supplied places table joined on its `query_key`.

    With `per` (say, address|city) one query stands for all rows of that key: the one of its first unlabelled row.
    Real-estate hits are ignored.
    """
    parsed = places.withColumn("__p", place_label("name", "types", "primary_type", "formatted_address"))
    hits = parsed.select(
        as_column("query_key"), F.col("__p.label").alias("place"), F.col("__p.city").alias("place_city"),
        as_column(place_order).alias("__place_order"),
    )
    rows = with_label_columns(df).withColumn("__query", F.when(unlabelled(), query).otherwise(""))
    if per is not None:
        rows = rows.withColumn("__per", F.when(unlabelled(), per))
        one = rows.where("__per is not null").groupBy("__per").agg(
            F.min_by(F.struct("__query", strip(city).alias("__first_city")), order_by).alias("__one")
        )
        rows = keyed_join(rows.drop("__query"), one, ["__per"])
        rows = rows.withColumns(
            {"__query": F.coalesce("__one.__query", F.lit("")), "__city": F.coalesce("__one.__first_city", F.lit(""))}
        )
    else:
        rows = rows.withColumn("__city", known(city))
    rows = attach_first(rows, hits, F.col("__query"), F.col("query_key"), ["place", "place_city"], "__place_order")
    use = unlabelled() & ~F.col("place").isin("", fv.REAL_ESTATE_LABEL)
    columns = [c for c in with_label_columns(df).columns if c not in (LABEL, CITY)]
    return rows.select(
        *[as_column(c) for c in columns],
        F.when(use, F.col("place")).otherwise(filled(LABEL)).alias(LABEL),
        F.when(use, F.coalesce(F.nullif("place_city", F.lit("")), F.col("__city"))).otherwise(filled(CITY)).alias(CITY),
    )


# --- spreading over an address -----------------------------------------------------------------


def _at_address(df: DataFrame, addr: str, city: str) -> DataFrame:
    return df.withColumn("__base", F.nullif(base_addr_key(addr, city), F.lit("|")))


def _votes(rows: DataFrame, keep: Column, order_by: str) -> DataFrame:
    """The most frequent (label, city) per base address; ties go to the pair seen first."""
    counted = (
        rows.where(F.col("__base").isNotNull() & ~unlabelled() & keep)
        .groupBy("__base", strip(LABEL).alias("l"), strip(CITY).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(order_by).alias("at"))
    )
    return counted.groupBy("__base").agg(
        F.min_by(F.struct("l", "c"), F.struct(-F.col("n"), F.col("at"))).alias("__vote")
    )


def _not_noise() -> Column:
    return ~is_bad_label(LABEL) & ~is_individual_label(LABEL)


def majority_label(
    df: DataFrame, addr: str, city: str, order_by: str = "_ord", exclude_noise: bool = True
) -> DataFrame:
    """Fill unlabelled rows with the most frequent label at their base address. Noise does not vote by default."""
    rows = _at_address(with_label_columns(df), addr, city)
    votes = _votes(rows, _not_noise() if exclude_noise else F.lit(True), order_by)
    return _take_vote(rows, votes, unlabelled())


def upgrade_generic(df: DataFrame, addr: str, city: str, order_by: str = "_ord", reviewed: str = "_user_reviewed") -> DataFrame:
    """Solo and group rows take the majority named label of their address unless a reviewer confirmed them."""
    rows = _at_address(with_label_columns(df), addr, city)
    generic = strip(LABEL).isin(fv.SOLO, fv.GROUP)
    votes = _votes(rows, _not_noise() & ~generic, order_by)
    free = filled(reviewed) != "yes" if reviewed in df.columns else F.lit(True)
    return _take_vote(rows, votes, F.col(LABEL).isin(fv.SOLO, fv.GROUP) & free)


def _take_vote(rows: DataFrame, votes: DataFrame, when: Column) -> DataFrame:
    columns = [c for c in rows.columns if c not in ("__base", LABEL, CITY)]
    use = when & F.col("__vote").isNotNull()
    return keyed_join(rows, votes, ["__base"]).select(
        *[as_column(c) for c in columns],
        F.when(use, F.col("__vote.l")).otherwise(filled(LABEL)).alias(LABEL),
        F.when(use, F.col("__vote.c")).otherwise(filled(CITY)).alias(CITY),
    )


def label_by_count(df: DataFrame, addr: str, city: str) -> DataFrame:
    """Rows still unlabelled become Group Practice when two or more rows share the base address, else Solo Practice."""
    rows = _at_address(with_label_columns(df), addr, city)
    crowd = rows.where("__base is not null").groupBy("__base").agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    columns = [c for c in rows.columns if c not in ("__base", LABEL, CITY)]
    label = F.when(F.col("__n") >= 2, fv.GROUP).otherwise(fv.SOLO)
    return keyed_join(rows, crowd, ["__base"]).select(
        *[as_column(c) for c in columns],
        F.when(unlabelled(), label).otherwise(filled(LABEL)).alias(LABEL),
        F.when(unlabelled(), known(city)).otherwise(filled(CITY)).alias(CITY),
    )


# --- cleaning and summary ----------------------------------------------------------------------


def clear_noise(df: DataFrame, reviewed: str = "_user_reviewed", extended: bool = True) -> DataFrame:
    """Blank out labels that are noise or one person; confirmed rows stay. `extended=False` tests the short list only."""
    noise = is_bad_label(LABEL, extended)
    if extended:
        noise = noise | is_individual_label(LABEL)
    if reviewed in df.columns:
        noise = noise & (filled(reviewed) != "yes")
    return df.withColumns(
        {LABEL: F.when(noise, "").otherwise(filled(LABEL)), CITY: F.when(noise, "").otherwise(filled(CITY))}
    )


def flag_likely_clinic(df: DataFrame, addr2: str | None, generic: bool = True, out: str = "_likely_clinic") -> DataFrame:
    """Mark rows whose second address line names a unit: generic rows as suite_address, or unlabelled as likely_clinic."""
    if not addr2 or addr2 not in df.columns:
        return df.withColumn(out, F.lit(""))
    open_ = filled(LABEL).isin(fv.SOLO, fv.GROUP) if generic else unlabelled()
    unit = known(addr2).rlike("(?iU)" + fv.UNIT_MARK)
    return df.withColumn(out, F.when(open_ & unit, "suite_address" if generic else "likely_clinic").otherwise(""))


def label_summary(df: DataFrame, top: int | None = None, skip_generic: bool = True) -> DataFrame:
    """Per label: providers, distinct cities and the sorted, title-cased city list, most providers first."""
    rows = df.where(filled(LABEL) != "")
    if skip_generic:
        rows = rows.where(~F.col(LABEL).isin(fv.SOLO, fv.GROUP))
    per_city = rows.groupBy(LABEL, norm(CITY).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    cities = F.array_sort(F.collect_set(F.when(F.col("c") != "", title_case("c"))))
    summary = (
        per_city.groupBy(LABEL)
        .agg(F.sum("n").alias("provider_count"), cities.alias("__cities"))
        .select(
            LABEL, "provider_count", F.size("__cities").alias("location_count"),
            F.array_join("__cities", ", ").alias("cities"),
        )
        .orderBy(F.desc("provider_count"), LABEL)
    )
    return summary.limit(top) if top else summary
