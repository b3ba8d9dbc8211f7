"""Whole jobs that hold lists against each other and report. Each takes tables and returns named tables, as in `flows`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.functions.addresses import missing_flags
from rollbook.functions.text import as_column, filled, norm, strip
from rollbook.operators import classifying, dedup, matching, reporting
from rollbook.plans.flows import Tables
from rollbook.scale import stored


def gold_against_reprocessed(
    gold: DataFrame, mailed: DataFrame, npi: str = "npi", last: str = "last_name", first: str = "first_name", full: str = "full_name",
    label: str = "health_system", city: str = "health_system_city", source: str = "_source_tab", order_by: str = "_ord",
) -> Tables:
    """Which people of the gold list were mailed, by identifier, then by name in either order; identifier matches carry the
    first label that the mailed list has for them. all, in_mailed, not_mailed, and a summary per source."""
    mail_names = F.array_union(names.slash_name_keys(last, first), names.slash_fullname_keys(full))
    flagged = matching.match_cascade(
        gold, mailed,
        {"npi": F.array(norm(npi)), "name": names.slash_name_keys(last, first)},
        {"npi": F.array(norm(npi)), "name": mail_names},
        order_by, "_in_mailed", "_match_method", "not_mailed",
    )
    labelled = mailed.select(as_column(order_by), norm(npi).alias("__npi"), strip(label).alias("_mailed_hs"), strip(city).alias("_mailed_hs_city"))
    by_npi = F.when(F.col("_match_method") == "npi", norm(npi)).otherwise("")
    rows = matching.attach_first(flagged, labelled.where("_mailed_hs <> ''"), by_npi, F.col("__npi"), ["_mailed_hs", "_mailed_hs_city"], order_by)
    rows = stored(rows, "gold-against-reprocessed")
    out = {"all": rows, "in_mailed": rows.where("_in_mailed"), "not_mailed": rows.where("not _in_mailed")}
    if source in gold.columns:
        out["summary"] = reporting.check_summary(rows, source, "_in_mailed")
    return out


def mailing_coverage(
    providers: Mapping[str, DataFrame], mailing: DataFrame, last: str, first: str, provider_addresses: Sequence[tuple[str, str, str]],
    full: str, mailing_address: tuple[str, str, str], order_by: str = "_ord",
) -> Tables:
    """Every table of providers against one mailing list and back; rows per table and way of matching."""
    stacked = None
    for rank, (name, df) in enumerate(providers.items()):
        own = df.withColumns({"tab": F.lit(name), order_by: F.struct(F.lit(rank).alias("file"), as_column(order_by).alias("row"))})
        stacked = own if stacked is None else stacked.unionByName(own, allowMissingColumns=True)
    forward, back = matching.coverage(stacked, mailing, last, first, provider_addresses, full, mailing_address, order_by)
    forward, back = stored(forward, "covered-providers"), stored(back, "covered-mailing")
    return {
        "providers": forward,
        "not_in_mailing": forward.where("not in_mailing_list"),
        "mailing_not_in_providers": back.where("not in_provider_file"),
        "summary": reporting.value_counts(forward, ["tab", "match_method"]),
        "mailing_summary": reporting.value_counts(back, ["match_method"]),
    }


def check_duplicates(a: DataFrame, b: DataFrame, a_names, a_city: str, b_names, b_city: str, order_by: str = "_ord") -> Tables:
    """Additions `b` that the original list `a` already has, those it has not, and rows per way of matching."""
    rows = stored(matching.duplicates_between(a, b, a_names, a_city, b_names, b_city, order_by), "duplicates-between")
    return {
        "duplicates": rows.where("duplicate_of_A").drop("duplicate_of_A", "match_method"),
        "unique": rows.where("not duplicate_of_A").drop("duplicate_of_A", "match_method"),
        "summary": reporting.value_counts(rows, ["match_method"]),
    }


def check_overlap(
    records: DataFrame, addition: DataFrame, npi: str = "npi", last: str = "last_name", first: str = "first_name", middle: str = "middle_name",
    source: str = "source", order_by: str = "_ord", zeros: bool = False,
) -> Tables:
    """People that several files have (pairs of files, and each person's files), rows per source, and which rows of an
    addition no file has, by identifier, then by name and middle initial."""
    ids = reporting.identifiers(records, npi, last, first, middle, source)
    files = ids.withColumn("source", F.substring_index("source", " / ", 1))

    def keys() -> dict:
        name = F.concat_ws("|", norm(last), norm(first), F.substring(norm(middle), 1, 1))
        return {"npi": F.array(F.when(norm(npi) != "nan", norm(npi)).otherwise("")), "name": F.array(F.when(name != "||", name).otherwise(""))}

    checked = stored(matching.match_cascade(addition, records, keys(), keys(), order_by, "in_provider_files", "match_method"), "addition-checked")
    return {
        "overlap_matrix": reporting.overlap_matrix(files, zeros),
        "overlap_details": reporting.overlap_details(ids),
        "row_counts": reporting.value_counts(records, [source], "row_count"),
        "addition": checked,
        "missing": checked.where("not in_provider_files").drop("in_provider_files", "match_method"),
    }


def _by_status(rows: DataFrame, miss: str, keep: Sequence[str], address: tuple[str, str, str], slots: int) -> Tables:
    rows = stored(rows, "address-status")
    several = {"multiple_addresses": "multiple_addresses", "same_address_variant": "same_address_variant", "not_found": miss,
               "name_collisions": "name_collision_different_people"}
    return {
        "all": rows,
        **{name: rows.where(F.col("address_status") == status) for name, status in several.items()},
        "compare": reporting.addresses_compare(rows, keep, *address, slots=slots),
        "addresses": reporting.found_addresses(rows, keep),
        "summary": reporting.value_counts(rows, ["address_status"]),
    }


def multiple_addresses(
    mailing: DataFrame, originals: DataFrame, mail_names, original_names, sets, keep: Sequence[str], address: tuple[str, str, str],
    slots: int = 4, order_by: str = "_ord",
) -> Tables:
    """Which mailed people have several addresses in the original files; those beside each other, and rows per status."""
    rows = classifying.address_status(mailing, originals, mail_names, original_names, sets, order_by=order_by)
    return _by_status(rows, "not_in_originals", keep, address, slots)


def multiple_addresses_round2(
    mailing: DataFrame, gold: DataFrame, npi: str | None, mail_names, gold_names, sets, keep: Sequence[str], address: tuple[str, str, str],
    slots: int = 4, order_by: str = "_ord",
) -> Tables:
    """As `multiple_addresses`, by identifier first and within the home states, with rows per status and way of matching."""
    rows = classifying.address_status_round2(mailing, gold, npi, mail_names, gold_names, sets, order_by=order_by)
    out = _by_status(rows, "not_in_gold", keep, address, slots)
    return {**out, "method_summary": reporting.value_counts(out["all"], ["address_status", "_match_method"])}


def check_round2(
    df: DataFrame, addresses: Sequence[str], state: str | None, zip_: str | None, npi: str = "npi", last: str = "last_name", first: str = "first_name",
) -> Tables:
    """Rows without address, state or ZIP, rows that share an identifier or a name, and how often each fault occurs."""
    issues = df.withColumn("_issues", missing_flags(addresses, state, zip_)).where("_issues <> ''")
    return {
        "address_issues": issues,
        "duplicate_npi": dedup.duplicate_rows(df, npi),
        "duplicate_name": dedup.duplicate_rows(df, dedup.pair_key(last, first), "|"),
        "issue_breakdown": reporting.flag_breakdown(issues, "_issues"),
    }


def postal_corrections(
    df: DataFrame, corrections: DataFrame, fields: Mapping[str, str], last: str = "last_name", first: str = "first_name", line2: str | None = None,
    silent: Sequence[str] = (), order_by: str = "_ord",
) -> Tables:
    """A list with the post office's corrections applied, the rows that changed, corrections for unknown names, and counts."""
    rows, unknown = matching.apply_corrections(df, corrections, fields, last, first, line2, silent, order_by)
    rows = stored(rows, "corrected")
    changed = rows.where("address_updated = 'Y'")
    return {"corrected": rows, "updated": changed, "not_found": unknown, "summary": reporting.check_counts({"updated": changed, "not_found": unknown})}


def _with_systems(df: DataFrame, labelled: DataFrame, addr: str, zip_: str, ref_addr: str, ref_zip: str, order_by: str) -> DataFrame:
    plain = df.drop("health_system", "health_system_city")
    return stored(matching.address_label_join(plain, labelled, addr, zip_, ref_addr, ref_zip, order_by=order_by), "with-systems")


def rank_health_systems(
    df: DataFrame, labelled: DataFrame, addr: str = "primary_address_1", zip_: str = "zip5", ref_addr: str = "primary_address_1",
    ref_zip: str = "zip5", order_by: str = "_ord",
) -> Tables:
    """Organisations of a list by the addresses of a labelled one: ranked, by city, and rows with and without."""
    rows = _with_systems(df, labelled, addr, zip_, ref_addr, ref_zip, order_by)
    ranked, by_city = reporting.rank_labels(rows)
    return {"ranked": ranked, "by_city": by_city, "matched": rows.where("health_system <> ''"), "unmatched": rows.where("health_system = ''")}


def compare_health_systems(
    df: DataFrame, labelled: DataFrame, other: DataFrame, system: str = "System", city: str = "Clinic_City", addr: str = "primary_address_1",
    zip_: str = "zip5", ref_addr: str = "primary_address_1", ref_zip: str = "zip5", order_by: str = "_ord",
) -> Tables:
    """Organisations of a list, by the addresses of a labelled one, against those of another list: alone and with their city."""
    rows = _with_systems(df, labelled, addr, zip_, ref_addr, ref_zip, order_by)
    counts = {"count_a": "round3_providers", "count_b": "dup_providers"}
    systems = stored(reporting.label_set_compare(rows, other, [("health_system", system)], **counts), "systems")
    cities = stored(reporting.label_set_compare(rows, other, [("health_system", system), ("health_system_city", city)], **counts), "system-cities")
    out: Tables = {"unmatched": rows.where(filled("health_system") == "")}
    for name, table in (("systems", systems), ("locations", cities)):
        out |= {name: table, **{f"{name}_{status}": table.where(F.col("status") == status) for status in ("only_in_a", "only_in_b", "in_both")}}
    return out
