"""The six-way comparison of a registry with a licensing board, and the classification of its ambiguous part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.credentials import first_credential, norm_credential
from rollbook.functions.names import name_key, name_key_mid
from rollbook.functions.text import as_column, filled, norm, strip, zip5
from rollbook.operators.reporting import consolidate
from rollbook.scale import keyed_join, stored


def name_verdicts(stacked: DataFrame) -> DataFrame:
    """Per match key its verdict: matched, multi, possible, single (one side only) or shadowed.

    Both sides are counted by one aggregation; only counts per key are moved. `possible` is a shared last and first name
    that no match key confirms; `shadowed` is a shared name confirmed under another middle initial, which belongs to no
    output.
    """
    side = F.col("_source_type")
    per_key = stacked.groupBy("_match_key", "_name_key").agg(F.count_if(side == "NPI").alias("n"), F.count_if(side == "MN").alias("m"))
    matched, multi = (F.col("n") == 1) & (F.col("m") == 1), (F.col("m") > 1) & (F.col("n") >= 1)
    per_key = per_key.withColumns({"matched": matched, "multi": multi})
    per_name = per_key.groupBy("_name_key").agg(
        ((F.max("n") > 0) & (F.max("m") > 0)).alias("shared"), F.max(F.col("matched") | F.col("multi")).alias("confirmed")
    )
    verdict = (
        F.when(F.col("matched"), "matched")
        .when(F.col("multi"), "multi")
        .when(~F.col("shared"), "single")
        .when(~F.col("confirmed"), "possible")
        .otherwise("shadowed")
    )
    return keyed_join(per_key, per_name, ["_name_key"], "inner").select("_match_key", verdict.alias("__verdict"))


def compare(
    npi: DataFrame, mn: DataFrame, home: str = "MN", order_by: str = "_ord", state: str = "primary_state"
) -> dict[str, DataFrame]:
    """matched_1to1, multi_specialty, right_only, left_only, left_only_oos and possible.

    The board is consolidated first. The primary key is last|first|middle initial; right-only rows outside the home
    state are dropped and left-only rows are split by it.
    """

    def keyed(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumns(
            {
                "_source_type": F.lit(kind),
                "_match_key": name_key_mid("last_name", "first_name", "middle_name" if "middle_name" in df.columns else F.lit("")),
                "_name_key": name_key("last_name", "first_name"),
            }
        )

    left, right = keyed(npi, "NPI"), keyed(consolidate(mn, order_by=order_by), "MN")
    # one table of both sides, written once; a second time with its verdicts, of which the six outputs are filters
    stacked = stored(left.unionByName(right, allowMissingColumns=True), "compare-both")
    judged = stored(keyed_join(stacked, name_verdicts(stacked), ["_match_key"]).where("__verdict <> 'shadowed'"), "compare-verdicts")

    def pick(verdict: str, kind: str | None = None) -> DataFrame:
        both = judged.where(F.col("__verdict") == verdict).drop("__verdict")
        both = both.fillna("", [n for n, t in both.dtypes if t == "string"])
        return both.withColumn("_match_type", F.lit(kind)) if kind else both

    def only(side: DataFrame, kind: str) -> DataFrame:
        return judged.where((F.col("__verdict") == "single") & (F.col("_source_type") == kind)).select(*[F.col(f"`{c}`") for c in side.columns])

    def at_home(df: DataFrame) -> Column:
        return F.upper(strip(state)) == home if state in df.columns else F.lit(True)

    return {
        "matched_1to1": pick("matched", "full_name+mid_initial"),
        "multi_specialty": pick("multi"),
        "right_only": only(right, "MN").where(at_home(right)),
        "left_only": only(left, "NPI").where(at_home(left)),
        "left_only_oos": only(left, "NPI").where(~at_home(left)),
        "possible": pick("possible", "name_no_middle"),
    }


def split_sources(stacked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stacked.where("_source_type = 'NPI'"), stacked.where("_source_type = 'MN'")


def match_quality(left_middle: Column | str, right_middle: Column | str) -> Column:
    """exact, suspect_middle, one_side_missing_middle or no_middle_either_side."""
    l, r = F.substring(norm(left_middle), 1, 1), F.substring(norm(right_middle), 1, 1)
    return (
        F.when((l != "") & (r != ""), F.when(l == r, "exact").otherwise("suspect_middle"))
        .when((l == "") & (r == ""), "no_middle_either_side")
        .otherwise("one_side_missing_middle")
    )


def zip_agreement(
    multi: DataFrame, primary_zip: str = "zip5", mailing_zip: str = "mailing_postal_code", out: str = "_npi_address_match"
) -> DataFrame:
    """Board rows flagged when their ZIP is a primary, else a mailing ZIP of a registry row of the same name."""
    registry = multi.where("_source_type = 'NPI'")
    kinds = [("matches_npi_primary_zip", primary_zip), ("matches_npi_mailing_zip", mailing_zip)]
    entries = F.array(
        *[F.struct(F.lit(i).alias("rank"), zip5(c).alias("zip")) for i, (_, c) in enumerate(kinds) if c in multi.columns]
    )
    known = (
        registry.select("_name_key", F.explode(entries).alias("e"))
        .where("e.zip <> ''")
        .groupBy("_name_key", F.col("e.zip").alias("__zip"))
        .agg(F.min("e.rank").alias("__rank"))
    )
    own = F.when(F.col("_source_type") == "MN", zip5(primary_zip))
    label = F.lit("")
    for i, (name, _) in enumerate(kinds):
        label = F.when(F.col("__rank") == i, name).otherwise(label)
    return keyed_join(multi.withColumn("__zip", own), known, ["_name_key", "__zip"]).select(
        *[as_column(c) for c in multi.columns], label.alias(out)
    )


def disambiguate(
    multi: DataFrame,
    registry_credentials: Sequence[str] = ("credential",),
    board_credentials: Sequence[str] = ("license_type_desc", "degree", "credential", "LicenseType"),
    agreement: str = "_npi_address_match",
    out: str = "_person_status",
) -> DataFrame:
    """Person status of the board rows: same_person_zip_match, same_person_credential_match, likely_different_person or
    unclear. A name has at most as many credential categories as there are, so the collected sets stay small."""
    registry = multi.where("_source_type = 'NPI'")
    present = [c for c in registry_credentials if c in multi.columns]
    categories = F.array_compact(F.array(*[F.nullif(norm_credential(c), F.lit("")) for c in present]))
    known = registry.groupBy("_name_key").agg(
        F.array_distinct(F.flatten(F.collect_set(categories))).alias("__categories")
    )
    rows = keyed_join(multi, known, ["_name_key"])
    own = first_credential([c for c in board_credentials if c in multi.columns])
    board = (F.col("_source_type") == "MN") & F.col("__categories").isNotNull()
    status = (
        F.when(~board, "unclear")
        .when(filled(agreement) != "", "same_person_zip_match")
        .when(F.coalesce(F.array_contains("__categories", own), F.lit(False)), "same_person_credential_match")
        .when(F.size("__categories") > 0, "likely_different_person")
        .otherwise("unclear")
    )
    return rows.select(*[as_column(c) for c in multi.columns], status.alias(out))
