"""Does a mailed person have one address, several spellings, several addresses, or several people behind the name?

Rows with the same set of keys get the same answer, so each distinct set is judged once and the verdict is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.addresses import norm_addr
from rollbook.functions.text import as_column, norm, zip5
from rollbook.operators.cleaning import in_states
from rollbook.scale import keyed_join, stored

AddressSet = tuple[str, str | None, str | None, str | None]


def _entries(
    refs: DataFrame, names: Column, sets: Sequence[AddressSet], npi: str | None, middle: str | None, order_by: str,
    profile: str, states: Sequence[str] | None,
) -> DataFrame:
    """(names, npi, middle, order, raw, norm): one row per reference row and address set that has an address."""

    def text(c: str | None, f) -> Column:
        return f(c) if c else F.lit("")

    def normed(a: str, c: str | None, z: str | None) -> Column:
        street = norm_addr(a, profile)
        return street if profile == "round2" else F.concat_ws("|", street, text(c, norm), text(z, zip5))

    slots = F.array(
        *[
            F.when(
                (norm(a) != "") & (in_states(s, states) if s and states else F.lit(True)),
                F.struct(
                    F.lit(i).alias("slot"),
                    F.concat_ws("|", norm(a), text(c, norm), text(z, zip5)).alias("raw"),
                    normed(a, c, z).alias("norm"),
                ),
            )
            for i, (a, c, z, s) in enumerate(sets)
        ]
    )
    rows = refs.select(
        names.alias("names"),
        text(npi, norm).alias("npi"),
        F.substring(text(middle, norm), 1, 1).alias("middle"),
        as_column(order_by).alias("row"),
        F.explode(F.array_compact(slots)).alias("s"),
    )
    return rows.select(
        "names", "npi", "middle", F.struct("row", F.col("s.slot").alias("slot")).alias("at"), "s.raw", "s.norm"
    )


def _per_key(entries: DataFrame, key: Column) -> DataFrame:
    """Distinct (key, npi, middle, raw, norm) with the first position."""
    return (
        entries.select(key.alias("key"), "npi", "middle", "raw", "norm", "at")
        .where("key <> ''")
        .groupBy("key", "npi", "middle", "raw", "norm")
        .agg(F.min("at").alias("at"))
    )


def _signature(keys: Column) -> Column:
    return F.array_join(F.array_sort(keys), "\u0001")


def _finish(rows: DataFrame, verdicts: DataFrame, group: str, columns: Sequence[str], miss: str) -> DataFrame:
    return keyed_join(rows, verdicts, [group]).select(
        *[as_column(c) for c in columns],
        F.coalesce("address_status", F.lit(miss)).alias("address_status"),
        F.coalesce("address_count", F.lit(0)).alias("address_count"),
        F.coalesce("addresses_found", F.lit("")).alias("addresses_found"),
    )


def _judge(asked: DataFrame, evidence: DataFrame, group: str, by_norm: bool) -> DataFrame:
    """Status, count and address text per distinct group of keys.

    Whether several people are behind a group is told by the least and the greatest NPI and middle initial, which costs a
    name of a million people four values. Only groups that are one person meet the addresses, only the others the list of
    their NPIs, which is made distinct per key before it meets them.
    """
    groups = asked.select(group).where(F.col(group).isNotNull()).distinct()
    keys = groups.select(group, F.explode(F.split(group, "\u0001")).alias("key")).where("key <> ''")
    marks = {"npi": F.nullif("npi", F.lit("")), "middle": F.nullif("middle", F.lit(""))}
    persons = evidence.groupBy("key").agg(*[f(c).alias(f"{n}_{e}") for n, c in marks.items() for e, f in (("lo", F.min), ("hi", F.max))])
    people = keyed_join(keys, persons, ["key"], "inner").groupBy(group).agg(
        F.coalesce(F.min("npi_lo") < F.max("npi_hi"), F.lit(False)).alias("npis"),
        F.coalesce(F.min("middle_lo") < F.max("middle_hi"), F.lit(False)).alias("middles"),
    )
    people = stored(people.select(group, (F.col("npis") | F.col("middles")).alias("several")), "people")

    def behind(rows: DataFrame, several: bool) -> DataFrame:
        wanted = people.where(F.col("several") == several).select(group)
        return keyed_join(rows, keyed_join(keys, wanted, [group], "left_semi"), ["key"], "inner")

    met = behind(evidence, False)
    if by_norm:
        longest = F.struct((-F.length("raw")).alias("len"), F.col("at"))
        slots = met.groupBy(group, "norm").agg(F.min("at").alias("at"), F.min_by("raw", longest).alias("raw"))
    else:
        slots = met.groupBy(group, "raw").agg(F.min("at").alias("at"), F.min_by("norm", "at").alias("norm"))
    addresses = slots.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("raws"), F.count_distinct("norm").alias("norms")
    )
    status = F.when(F.size("raws") == 1, "unique")
    if not by_norm:
        status = status.when(F.col("norms") == 1, "same_address_variant")
    calm = addresses.select(
        group, status.otherwise("multiple_addresses").alias("address_status"), F.size("raws").alias("address_count"),
        F.array_join(F.transform("raws", lambda r: r["raw"]), " | ").alias("addresses_found"),
    )
    named = behind(evidence.select("key", "npi", "middle").distinct(), True).groupBy(group).agg(
        F.array_sort(F.collect_set(marks["npi"])).alias("npis"), F.count_distinct(marks["middle"]).cast("int").alias("middles")
    )
    listed = F.when(F.size("npis") > 0, F.array_join("npis", " | ")).otherwise("no NPI")
    clash = named.select(
        group, F.lit("name_collision_different_people").alias("address_status"),
        F.when(F.size("npis") > 0, F.size("npis")).otherwise(F.col("middles")).alias("address_count"),
        F.concat(F.lit("NPIs: "), listed).alias("addresses_found"),
    )
    return calm.unionByName(clash)


def address_status(
    mailing: DataFrame,
    refs: DataFrame,
    names: Column,
    ref_names: Column,
    ref_sets: Sequence[AddressSet],
    ref_npi: str | None = "npi",
    ref_middle: str | None = "middle_name",
    order_by: str = "_ord",
) -> DataFrame:
    """unique, same_address_variant, multiple_addresses, name_collision_different_people or not_in_originals.

    A collision is more than one NPI or more than one middle initial behind the row's name keys. Addresses compare as
    address|city|zip, raw and abbreviated (`multi` profile).
    """
    entries = _entries(refs, ref_names, ref_sets, ref_npi, ref_middle, order_by, "multi", None)
    evidence = stored(_per_key(entries.withColumn("name", F.explode("names")), F.col("name")), "evidence")
    rows = stored(mailing.withColumn("__group", F.nullif(_signature(names), F.lit(""))), "asked")
    return _finish(rows, _judge(rows, evidence, "__group", False), "__group", mailing.columns, "not_in_originals")


def address_status_round2(
    mailing: DataFrame,
    refs: DataFrame,
    npi: str | None,
    names: Column,
    ref_names: Column,
    ref_sets: Sequence[AddressSet],
    ref_npi: str | None = "npi",
    ref_middle: str | None = "middle_name",
    states: Sequence[str] = ("mn", "wi"),
    order_by: str = "_ord",
) -> DataFrame:
    """unique, multiple_addresses, name_collision_different_people or not_in_gold, with the method npi, name or none.

    The NPI is tried first, then the name keys. Only addresses in the allowed states count, and only the abbreviated
    street is compared (`round2` profile); the longest spelling is shown.
    """
    entries = _entries(refs, ref_names, ref_sets, ref_npi, ref_middle, order_by, "round2", states)
    # one row per key: the NPI and every name, told apart by a prefix
    number = F.when(F.col("npi") != "", F.concat(F.lit("npi:"), F.col("npi")))
    called = F.transform(F.filter("names", lambda k: k != ""), lambda k: F.concat(F.lit("name:"), k))
    each = entries.withColumn("key", F.explode(F.concat(F.array_compact(F.array(number)), called)))
    evidence = stored(_per_key(each, F.col("key")), "evidence")
    wanted = norm(npi) if npi else F.lit("")
    signature = _signature(F.transform(F.filter(names, lambda k: k != ""), lambda k: F.concat(F.lit("name:"), k)))
    rows = mailing.withColumns({"__npi": F.when(wanted != "", F.concat(F.lit("npi:"), wanted)), "__names": F.nullif(signature, F.lit(""))})
    known = evidence.where(F.col("key").startswith("npi:")).select(F.col("key").alias("__npi")).distinct()
    rows = keyed_join(rows, known.withColumn("__known", F.lit(True)), ["__npi"])
    rows = stored(rows.withColumn("__group", F.when(F.col("__known"), F.col("__npi")).otherwise(F.col("__names"))), "asked")
    verdicts = _judge(rows, evidence, "__group", True)
    done = _finish(rows, verdicts, "__group", [*mailing.columns, "__known"], "not_in_gold")
    method = F.when(F.col("address_status") == "not_in_gold", "none").when(F.col("__known"), "npi").otherwise("name")
    return done.withColumn("_match_method", method).drop("__known")
