"""Cleaning, filtering, ordering of rows and columns, and the merge of several files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.text import as_column, norm, norm_name, norm_phone, strip, title_case, zip5
from rollbook.operators.dedup import dedup_first, flag_duplicates
from rollbook.sources.tables import read_union

DEDUP_MODES = ("npi", "name", "name+zip", "name+city", "none")


def normalise(df: DataFrame) -> DataFrame:
    """Title-case names and cities, format phones, cut ZIPs, strip every other string; one projection."""

    def expr(name: str, kind: str) -> Column:
        if name in fv.TITLE_CASED_COLUMNS:
            return title_case(name)
        if "telephone" in name or "fax" in name:
            return norm_phone(name)
        if name == "zip5":
            return zip5(name)
        return strip(name) if kind == "string" else as_column(name)

    return df.select(*[expr(n, t).alias(n) for n, t in df.dtypes])


def _dedup_keys(df: DataFrame, mode: str) -> list[Column]:
    if mode == "npi":
        return [as_column("npi")] if "npi" in df.columns else []
    keys = []
    if {"last_name", "first_name"} <= set(df.columns):
        keys.append(F.concat_ws("|", norm_name("last_name"), norm_name("first_name")))
    if mode == "name+zip" and "zip5" in df.columns:
        keys.append(zip5("zip5"))
    if mode == "name+city" and "primary_city" in df.columns:
        keys.append(norm_name("primary_city"))
    return keys


def clean(
    df: DataFrame,
    active_only: bool = False,
    dedup_on: str = "npi",
    sort_keys: Sequence[str] | None = None,
    order_by: str = "_ord",
    blank_is_key: bool = False,
) -> DataFrame:
    """Normalise, keep active rows, keep the first row per key, sort by the keys that exist (`()` for no sort).

    In npi mode rows without NPI all stay, unless `blank_is_key` asks for blank to count as one value.
    """
    if dedup_on not in DEDUP_MODES:
        raise ValueError(f"unknown dedup mode {dedup_on!r}; one of {DEDUP_MODES}")
    rows = normalise(df)
    if active_only and "status" in rows.columns:
        rows = rows.where(F.upper("status") == "A")
    keys = [] if dedup_on == "none" else _dedup_keys(rows, dedup_on)
    if keys:
        rows = dedup_first(rows, keys, order_by, blank_is_key=blank_is_key or dedup_on != "npi")
    return sort_rows(rows, fv.NAME_SORT if sort_keys is None else sort_keys, order_by)


def sort_rows(
    df: DataFrame, keys: Sequence[str], order_by: str | None = "_ord", ignore_case: bool = False
) -> DataFrame:
    """Range-partitioned sort by the keys that exist. The order column is the last key, so equal keys still spread."""
    valid = [k for k in keys if k in df.columns]
    if not valid:
        return df
    exprs = [F.lower(as_column(k)) if ignore_case else as_column(k) for k in valid]
    if order_by and order_by in df.columns:
        exprs.append(as_column(order_by))
    return df.orderBy(*exprs)


def sort_by_location(df: DataFrame, order_by: str | None = "_ord") -> DataFrame:
    """Sort so that rows of one address stand together."""
    return sort_rows(df, fv.LOCATION_SORT, order_by)


def reorder(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, then the rest in their order."""
    head = [c for c in preferred if c in df.columns]
    return df.select(*[as_column(c) for c in head + [c for c in df.columns if c not in set(head)]])


def in_states(state: Column | str, allowed: Sequence[str] = ("mn", "wi")) -> Column:
    """True for an allowed or blank state."""
    return norm(state).isin("", *[a.lower() for a in allowed])


def address_entries(
    df: DataFrame, sets: Sequence[tuple[str, str | None, str | None, str | None]]
) -> Column:
    """The address sets of a row as an array of (addr, city, zip, state)."""

    def text(c: str | None) -> Column:
        return strip(c) if c and c in df.columns else F.lit("")

    return F.array(
        *[
            F.struct(text(a).alias("addr"), text(c).alias("city"), text(z).alias("zip"), text(s).alias("state"))
            for a, c, z, s in sets
        ]
    )


def restrict_states(
    df: DataFrame,
    sets: Sequence[tuple[str, str | None, str | None, str | None]],
    allowed: Sequence[str] = ("mn", "wi"),
    out: str = "addresses",
) -> DataFrame:
    """Add the array of non-blank addresses whose state is allowed or blank."""
    kept = F.filter(address_entries(df, sets), lambda e: (norm(e["addr"]) != "") & in_states(e["state"], allowed))
    return df.withColumn(out, kept)


def merge(
    spark: SparkSession,
    paths: Sequence[str],
    column_map: dict[str, str] | None = None,
    active_only: bool = False,
    dedup_on: str = "none",
    sort_keys: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(main, review): union of the files, duplicates flagged before anything is removed, then `clean`.

    The review table holds the repeated names, group by group and file by file.
    """
    flagged = flag_duplicates(read_union(spark, paths, column_map))
    return clean(flagged, active_only, dedup_on, sort_keys), review_table(flagged)


def review_table(flagged: DataFrame, order_by: str = "_ord") -> DataFrame:
    return flagged.where("_dupe_count > 1").orderBy("_dupe_group", "source_file", order_by)
