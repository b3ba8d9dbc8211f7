"""Deduplication. One row per key is chosen by partially aggregated min_by, so a frequent key shrinks before it moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.names import first_token_key, name_key, parse_full_name, strip_suffix
from rollbook.functions.text import (
    as_column, coalesce_blank, count_nonempty, digits, filled, first_word, let, norm, strip, valid_npi, zip5,
)
from rollbook.scale import global_rank, keyed_join
from rollbook.sources.columns import resolve


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[as_column(c) for c in df.columns])


def first_by(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key the row with the smallest order value; `columns` limits what is kept."""
    kept = F.struct(*[as_column(c) for c in (columns or df.columns)])
    grouped = df.groupBy(*[as_column(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return grouped.agg(F.min_by(kept, order).alias("__row")).select("__row.*")


def dedup_first(
    df: DataFrame, keys: Sequence[Column | str], order_by: str = "_ord", blank_is_key: bool = True
) -> DataFrame:
    """Keep the first row per key. With `blank_is_key=False` a row whose keys are all blank stays on its own."""
    exprs = [as_column(k) for k in keys]
    lone = F.lit(None)
    if not blank_is_key:
        blank = F.lit(True)
        for e in exprs:
            blank = blank & (filled(e) == "")
        lone = F.when(blank, as_column(order_by))
    grouped = df.groupBy(*[e.alias(f"__k{i}") for i, e in enumerate(exprs)], lone.alias("__lone"))
    return grouped.agg(F.min_by(whole_row(df), as_column(order_by)).alias("__row")).select("__row.*")


def dropped_report(
    df: DataFrame, key: str, order_by: str = "_ord", blank_is_key: bool = False, report: str = "_fields_differing_from_kept"
) -> DataFrame:
    """The rows that `dedup_first` removes, with the names of the fields that differ from the kept row."""
    compared = [c for c in df.columns if c not in (key, order_by)]
    rows = df if blank_is_key else df.where(filled(key) != "")
    kept = (
        rows.groupBy(key)
        .agg(
            F.min_by(F.struct(order_by, *[as_column(c) for c in compared]), order_by).alias("__kept"),
            F.count(F.lit(1)).alias("__n"),
        )
        .where("__n > 1")
        .drop("__n")
    )
    differing = F.array_join(
        F.array_compact(
            F.array(*[F.when(filled(c) != filled(F.col("__kept")[c]), F.lit(c)) for c in compared])
        ),
        ", ",
    )
    return (
        keyed_join(rows, kept, [key], "inner")
        .where(as_column(order_by) != F.col("__kept")[order_by])
        .withColumn(report, F.when(differing == "", "(identical)").otherwise(differing))
        .select(*df.columns, report)
    )


def flag_duplicates(
    df: DataFrame, last: str = "last_name", first: str = "first_name", zip_: str = "zip5", source: str = "source_file"
) -> DataFrame:
    """Inspection columns, no row removed.

    _name_key, _dupe_count, _dupe_group (1.. over the sorted repeated names, 0 for single ones), _files_in_group, and
    _zip_match = 'Y' when another file has a row of the same name and the same non-blank ZIP.
    """
    rows = df.withColumn("_name_key", name_key(last, first)).withColumn("__zip", zip5(zip_))
    per_file = rows.groupBy("_name_key", "__zip", source).agg(F.count(F.lit(1)).alias("__n"))
    per_zip = per_file.groupBy("_name_key", "__zip").agg(F.sum("__n").alias("__n"), F.collect_set(source).alias("__files"))
    # a ZIP that several files have for a name; one table per name, so the rows are joined once
    shared = F.collect_list(F.when((F.col("__zip") != "") & (F.size("__files") > 1), F.col("__zip")))
    files = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__files"))))
    names = per_zip.groupBy("_name_key").agg(
        F.sum("__n").alias("_dupe_count"), F.array_join(files, ", ").alias("__files"), shared.alias("__shared")
    ).where("_dupe_count > 1")
    groups = global_rank(names, [F.col("_name_key")], "_dupe_group")
    return keyed_join(rows, groups, ["_name_key"]).select(
        *df.columns,
        "_name_key",
        F.coalesce("_dupe_count", F.lit(1)).alias("_dupe_count"),
        F.coalesce("_dupe_group", F.lit(0)).alias("_dupe_group"),
        F.coalesce("__files", F.lit("")).alias("_files_in_group"),
        F.when(F.array_contains("__shared", F.col("__zip")), "Y").otherwise("N").alias("_zip_match"),
    )


def _rank_of(c: str, ranks: Mapping[str, int]) -> Column:
    chain = F.lit(fv.UNKNOWN_RANK)
    for name, rank in ranks.items():
        chain = F.when(as_column(c) == name, rank).otherwise(chain)
    return chain


def dedup_priority(
    df: DataFrame,
    tab_ranks: Mapping[str, int] = fv.TAB_RANKS,
    file_ranks: Mapping[str, int] | None = None,
    order_by: str = "_ord",
    npi: str = "npi",
    last: str = "last_name",
    first: str = "first_name",
    middle: str = "middle_name",
    zips: Sequence[str] = ("npi_primary_zip", "zip5", "mn_zip"),
    tab: str = "_source_tab",
    file: str = "_source_file",
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed). Rows rank by tab, then file, then order; the best row per key stays.

    The key is a valid NPI, else last|first|middle|zip. Rows without any of these are removed. Removed rows say why.
    """
    zip_values = [F.nullif(zip5(z), F.lit("")) for z in zips if z in df.columns]
    name = F.concat_ws("|", norm(last), norm(first), norm(middle), F.coalesce(*zip_values, F.lit("")))
    rows = df.withColumn("__number", valid_npi(npi))
    rows = rows.withColumns(
        {"__npi": F.col("__number") != "", "__key": F.when(F.col("__number") != "", F.col("__number")).otherwise(name)}
    ).drop("__number")
    order = F.struct(_rank_of(tab, tab_ranks), _rank_of(file, file_ranks or {}), as_column(order_by))
    usable = rows.where(F.col("__key") != "|||")
    grouped = usable.groupBy("__npi", "__key")
    kept = grouped.agg(F.min_by(whole_row(df), order).alias("__row")).select("__row.*")
    winners = grouped.agg(F.min_by(as_column(order_by), order).alias(order_by)).select(order_by)
    removed = rows.join(winners, order_by, "left_anti").select(
        *df.columns,
        F.when(F.col("__npi"), "duplicate_npi").otherwise("duplicate_name_zip").alias("_removed_by"),
        F.when(F.col("__npi"), "").otherwise(F.col("__key")).alias("_dedup_key"),
    )
    return kept, removed


def add_gold_addresses(df: DataFrame) -> DataFrame:
    """The coalesced _addr1, _addr2, _city, _zip, _mail_addr, _mail_city and _mail_zip columns."""
    plans = {
        "_addr1": ("npi_primary_address_1", "primary_address_1", "mn_address_1"),
        "_addr2": ("npi_primary_address_2", "primary_address_2", "mn_address_2"),
        "_city": ("npi_primary_city", "primary_city", "mn_city"),
        "_zip": ("npi_primary_zip", "zip5", "mn_zip"),
        "_mail_addr": ("npi_mailing_address_1", "mailing_address_1"),
        "_mail_city": ("npi_mailing_city", "mailing_city"),
        "_mail_zip": ("npi_mailing_zip", "mailing_postal_code"),
    }
    return df.withColumns({n: coalesce_blank(*[c for c in cs if c in df.columns]) for n, cs in plans.items()})


def completeness_key(npi: str | None, full: str | None, last: str | None, first: str | None) -> Column:
    """'npi:...' for ten digits, else 'name:last first' with the name taken from the full name when there is one."""
    parsed = parse_full_name(norm(full)) if full else F.struct(F.lit("").alias("last"), F.lit("").alias("first"))
    surname, given = norm(last) if last else F.lit(""), first_word(norm(first)) if first else F.lit("")
    parts = F.struct(
        (digits(npi) if npi else F.lit("")).alias("n"), filled(full or F.lit("")).alias("full"), surname.alias("l"),
        given.alias("f"), parsed.alias("p"),
    )

    def key(x: Column) -> Column:
        whole = strip(x["full"]) != ""
        l = F.when(whole, x["p"]["last"]).otherwise(x["l"])
        f = F.when(whole, x["p"]["first"]).otherwise(x["f"])
        name = F.when(l == "", "").otherwise(F.trim(F.concat(F.lit("name:"), l, F.lit(" "), f)))
        return F.when(F.length(x["n"]) == 10, F.concat(F.lit("npi:"), x["n"])).otherwise(name)

    return let(parts, key)


def dedup_most_complete(
    df: DataFrame,
    order_by: str = "_ord",
    npi: str | None = "npi",
    full: str | None = None,
    last: str | None = "last_name",
    first: str | None = "first_name",
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): per key the row with the most filled fields, the first one on ties. Keyless rows all stay."""
    counted = [c for c in df.columns if c != order_by]
    rows = df.withColumn("_dedup_key", completeness_key(npi, full, last, first)).withColumn(
        "_field_count", count_nonempty(counted)
    )
    order = F.struct(-F.col("_field_count"), as_column(order_by))
    lone = F.when(F.col("_dedup_key") == "", as_column(order_by)).alias("__lone")
    grouped = rows.groupBy(F.col("_dedup_key").alias("__key"), lone)
    kept = grouped.agg(F.min_by(whole_row(rows), order).alias("__row")).select("__row.*")
    winners = grouped.agg(F.min_by(as_column(order_by), order).alias(order_by)).select(order_by)
    return kept, rows.join(winners, order_by, "left_anti").select(*rows.columns)


def union_first(
    sources: Sequence[tuple[DataFrame, str]], order_by: str = "_ord", last: Sequence[str] | None = None,
    first: Sequence[str] | None = None,
) -> DataFrame:
    """Stack (table, label) pairs in priority order and keep the first row per cleaned last name and first token."""
    last_names = last or ["Last_Name", "last_name", "LastName", "Last Name"]
    first_names = first or ["First_Name", "first_name", "FirstName", "First Name"]
    stacked = None
    for rank, (df, label) in enumerate(sources):
        l, f = resolve(df, last_names, loose=True), resolve(df, first_names, loose=True)
        if not l or not f:
            continue
        part = df.select(
            filled(l).alias("last_name"),
            filled(f).alias("first_name"),
            F.lit(label).alias("source"),
            first_token_key(l, f).alias("_key"),
            F.struct(F.lit(rank).alias("source"), as_column(order_by).alias("row")).alias("__order"),
        ).where(F.col("_key") != "|")
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no source has a last and a first name column")
    return first_by(stacked, ["_key"], F.col("__order"), ["last_name", "first_name", "source", "_key"])


def duplicate_rows(df: DataFrame, key: Column | str, blank: str = "") -> DataFrame:
    """All rows of any key seen more than once; the blank key is ignored."""
    rows = df.withColumn("__key", key if isinstance(key, Column) else norm(key)).where(F.col("__key") != blank)
    repeated = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key")
    return keyed_join(rows, repeated, ["__key"], "left_semi").select(*df.columns)


def pair_key(a: str, b: str) -> Column:
    """'a|b' with one trailing suffix removed; '|' when both are blank."""
    return strip_suffix(F.concat_ws("|", norm(a), norm(b)))

