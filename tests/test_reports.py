import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.operators import classifying, labelling, reporting


@pytest.fixture(params=[False, True], ids=["small", "spread"])
def either(request):
    if request.param:
        request.getfixturevalue("spread")


def test_consolidate_joins_in_first_seen_order(table):
    df = table(
        "last_name first_name primary_address_1 zip5 license_nbr certification discipined note",
        ("Doe", "J", "1 Oak Street", "55401", " b ", "", "N", "x"), ("DOE", "j.", "1 oak st.", "55401-9", "A", "", "y", "z"), ("Doe", "J", "1 Oak St", "55401", "B", "", "N", ""),
        ("Roe", "K", "2", "5", " raw ", "", "n", ""))
    got = rows_of(reporting.consolidate(df), "_ord", "license_nbr", "certification", "discipined", "note", "_mn_specialty_count")
    assert got == [(0, "b | A", "", "Y", "x", 3), (3, " raw ", "", "n", "", 1)]


def test_pivot_wide(table):
    left = table("_name_key last_name primary_address_1 zip5 npi license_type_desc", ("a", "A", "1 L", "5", "9", ""), ("a", "A2", "x", "6", "8", ""), ("b", "B", "2 L", "7", "", ""))
    right = table("_name_key last_name primary_address_1 license_type_desc degree _match_type", ("a", "A", "1 R", "MD", "", "m"), ("a", "A", "2 R", "md", "", "m"), ("c", "C", "9", "RN", "", "m"))
    wide = reporting.pivot_wide(left, right)
    assert wide.columns == ["last_name", "npi", "npi_primary_address_1", "npi_primary_zip", "mn_address_1", "license_type_desc", "_match_type"]
    assert rows_of(wide, "last_name", "npi_primary_address_1", "mn_address_1", "license_type_desc") == [("A", "1 L", "1 R | 2 R", "MD"), ("B", "2 L", "", "")]


def test_addresses_wide_and_reconciliation(either, table):
    df = table(
        "last_name first_name primary_address_1 primary_city zip5",
        ("Doe MD", "Jane A", "1 A", "X", "55401"), ("doe", "jane", "1  a", "x", "55401-9"), ("Doe", "Jane", "", "", ""), ("Doe", "Jane", "2 B", "X", "5"),
        ("", "", "3", "", ""), ("", "", "3", "", ""))
    wide, dropped = reporting.addresses_wide(df, slots=3)
    assert rows_of(wide, "_ord", "num_addresses", "address_1", "address_2", "address_3") == [
        (0, 3, "1 A", "", "2 B"), (4, 1, "3", "", ""), (5, 1, "3", "", "")]
    assert rows_of(dropped, "dup_address", "norm_zip", "all_seen") == [("1  a", "55401", "1 a|x|55401")]
    count = reporting.reconcile(df, wide, dropped).first()
    assert count["input_rows"] == 6 and count["difference"] == 0
    grouped, _ = reporting.addresses_wide(df, blank_is_key=True, slots=1)
    assert grouped.count() == 2


def test_nameless_rows_stay_apart_on_request(either, table):
    df = table("last_name first_name primary_address_1 zip5 license_nbr", ("", "", "", "", "A"), ("", "", "", "", "B"), ("Doe", "Jo", "1", "5", "C"), ("Doe", "Jo", "1", "5", "it's | \\x"))
    fields = ["license_nbr"]
    together = reporting.consolidate(df, concat_fields=fields)
    assert rows_of(together, "_ord", "license_nbr", "_mn_specialty_count") == [(0, "A | B", 2), (2, "C | it's | \\x", 2)]
    apart = reporting.consolidate(df, concat_fields=fields, blank_is_key=False)
    assert rows_of(apart, "_ord", "license_nbr", "_mn_specialty_count") == [(0, "A", 1), (1, "B", 1), (2, "C | it's | \\x", 2)]
    key = names.name_key("last_name", "first_name")
    left, right = df.select("_ord", "last_name", "first_name").withColumn("_name_key", key), df.withColumn("_name_key", key)
    wide = reporting.pivot_wide(left, right, blank_is_key=False)
    assert rows_of(wide, "last_name", "license_nbr") == [("", ""), ("", ""), ("Doe", "C | it's | \\x")]


def test_address_slots_of_a_busy_person(spark):
    df = spark.range(10_000).select(
        F.col("id").alias("_ord"), F.lit("Doe").alias("last_name"), F.lit("Jane").alias("first_name"),
        F.concat(F.lit("street "), F.col("id") % 9_000).alias("primary_address_1"), F.lit("X").alias("primary_city"), F.lit("55401").alias("zip5"))
    long = reporting.address_slots(df)
    assert long.columns == ["person", "slot", "at", "address", "city", "zip"]
    assert long.agg(F.count("*"), F.max("slot"), F.max("person"), F.count_if(F.col("slot") != F.col("at") + 1)).first()[:] == (9_000, 9_000, 0, 0)
    wide, _ = reporting.addresses_wide(df, slots=2)
    assert len(wide.columns) == 5 + 2 * 3 and rows_of(wide, "num_addresses", "address_2") == [(9_000, "street 1")]


def test_found_addresses_in_long_form(spark):
    df = spark.createDataFrame([(1, "multiple_addresses", "1 a|x|5 | 2 b||"), (2, "unique", "3 c|y|6")], "_ord long, address_status string, addresses_found string")
    assert rows_of(reporting.found_addresses(df, ["_ord"]), "_ord", "slot", "addr", "city", "zip") == [(1, 1, "1 a", "x", "5"), (1, 2, "2 b", "", "")]


def test_overlaps(table):
    df = table(
        "npi l f m source", ("1", "", "", "", "f1 / a"), ("1", "", "", "", "f2 / a"), ("1", "", "", "", "f3 / b"), ("", "Doe", "J", "Q", "f1 / a"), ("", "doe", "j", "q.", "f1 / b"),
        ("", "Doe", "J", "Q", "f3 / a"), ("", "", "", "", "f2 / a"), ("", "", "", "", "f1 / a"))
    ids = reporting.identifiers(df, "npi", "l", "f", "m", "source")
    files = ids.withColumn("source", F.substring_index("source", " / ", 1))
    assert rows_of(reporting.overlap_matrix(files), "file_1", "file_2", "shared_by_npi", "shared_by_name", "total_shared") == [
        ("f1", "f2", 1, 0, 1), ("f1", "f3", 1, 1, 2), ("f2", "f3", 1, 0, 1)]
    apart = table("npi l f m source", *[(str(i), "", "", "", f"s{i}") for i in range(300)])
    assert reporting.overlap_matrix(reporting.identifiers(apart, "npi", "l", "f", "m", "source")).count() == 0
    every = reporting.overlap_matrix(files.unionByName(files.limit(1).withColumn("source", F.lit("f9"))), zeros=True)
    assert every.where("file_2 = 'f9'").count() == 3
    assert rows_of(reporting.overlap_details(ids), "match_type", "identifier", "files", "sources") == [
        ("name", "doe|j|q", "f1 | f3", "f1 / a | f1 / b | f3 / a"), ("npi", "1", "f1 | f2 | f3", "f1 / a | f2 / a | f3 / b")]


def test_rank_and_compare_labels(either, table):
    df = table("health_system health_system_city", ("a", "x"), ("a", "x"), ("a", ""), ("b", "y"), ("c", "y"), ("", "z"))
    ranked, by_city = reporting.rank_labels(df)
    assert rows_of(ranked, "rank", "health_system", "total_providers", "cities") == [(1, "a", 3, "x (2), (unknown) (1)"), (2, "b", 1, "y (1)"), (3, "c", 1, "y (1)")]
    assert by_city.count() == 4
    other = table("System", ("A ",), ("d",), ("",))
    got = reporting.label_set_compare(df, other, [("health_system", "System")])
    assert rows_of(got, "health_system", "a_providers", "b_providers", "status") == [
        ("a", 3, 1, "in_both"), ("b", 1, 0, "only_in_a"), ("c", 1, 0, "only_in_a"), ("d", 0, 1, "only_in_b")]


def test_profile_and_flags(table):
    df = table("a b c", ("", "x" * 70, ""), ("v", "y", ""))
    assert rows_of(reporting.profile(df), "column", "rows", "example") == [("a", 2, "v"), ("b", 2, "x" * 57 + "..."), ("c", 2, "(empty)")]
    flags = table("f", ("missing_zip|missing_state",), ("missing_zip",), ("",))
    assert [tuple(r) for r in reporting.flag_breakdown(flags, "f").collect()] == [("missing_zip", 2), ("missing_state", 1)]


# --- labels ------------------------------------------------------------------------------------


@pytest.fixture
def clinics(table):
    return table(
        "a1 a2 city health_system health_system_city",
        ("1 Main St Ste 1", "", "Edina", "Lake Clinic", "Edina"), ("1 Main St Ste 2", "", "edina", "", ""), ("1 Main St", "", "Edina", "Hill Clinic", "Edina"),
        ("1 Main St", "", "Edina", "Jane Roe, MD", "Edina"), ("1 Main St", "", "Edina", "Jane Roe, MD", "Edina"), ("1 Main St", "Suite 9", "Edina", "Solo Practice", "Edina"),
        ("", "", "", "", ""), ("9 Elm", "", "Anoka", "", ""))


def test_majority_ties_go_to_the_first_label(either, clinics):
    got = labelling.majority_label(clinics, "a1", "city")
    assert rows_of(got, "_ord", "health_system")[1] == (1, "Lake Clinic")
    any_label = labelling.majority_label(clinics, "a1", "city", exclude_noise=False)
    assert rows_of(any_label, "_ord", "health_system")[1] == (1, "Jane Roe, MD")
    assert rows_of(got, "_ord", "health_system")[6:] == [(6, ""), (7, "")]


def test_upgrade_count_and_noise(clinics):
    assert rows_of(labelling.upgrade_generic(clinics, "a1", "city"), "_ord", "health_system")[5] == (5, "Lake Clinic")
    reviewed = clinics.withColumn("_user_reviewed", F.lit("yes"))
    assert rows_of(labelling.upgrade_generic(reviewed, "a1", "city"), "_ord", "health_system")[5] == (5, "Solo Practice")
    counted = rows_of(labelling.label_by_count(clinics, "a1", "city"), "_ord", "health_system", "health_system_city")
    assert counted[1] == (1, "Group Practice", "edina") and counted[6:] == [(6, "Solo Practice", ""), (7, "Solo Practice", "Anoka")]
    assert rows_of(labelling.clear_noise(clinics), "_ord", "health_system")[3] == (3, "")
    assert rows_of(labelling.clear_noise(reviewed), "_ord", "health_system")[3] == (3, "Jane Roe, MD")
    assert rows_of(labelling.flag_likely_clinic(clinics, "a2"), "_ord", "_likely_clinic")[5] == (5, "suite_address")


def test_assign_label_cascade(table):
    df = table(
        "a1 a2 a3 city health_system health_system_city",
        ("420 Oak  St", "", "", "X", "", ""), ("1 Delta Rd", "", "", "X", "", ""), ("Department of Care", "1 Delta Rd", "", "X", "", ""), ("Lakes Clinic", "", "", "X", "", ""),
        ("5 Elm", "", "River Clinic", "X", "", ""), ("7 Fir", "", "", "X", "", ""), ("8 Fir", "7 FIR", "", "X", "", ""), ("9", "", "", "X", "kept", "K"), ("9", "", "", "X", "", ""))
    overrides = table("address label city", ("420 oak st", "Oak Health", "O")).drop("_ord")
    known = table("addr health_system health_system_city", ("7 fir", "nan", ""), ("7 fir", "Fir Health", ""), ("7 fir", "Later", "L"))
    ref = labelling.label_reference([known], ["addr"])
    got = labelling.assign_label(df, overrides, [(r"\bdelta\b", "Delta Health", "D")], ref, "a1", "a2", "a3", "city")
    assert rows_of(got, "_ord", "health_system", "health_system_city") == [
        (0, "Oak Health", "O"), (1, "Delta Health", "D"), (2, "Delta Health", "D"), (3, "Lakes Clinic", "X"), (4, "River Clinic", "X"), (5, "Fir Health", "X"),
        (6, "Fir Health", "X"), (7, "kept", "K"), (8, "", "")]


def test_enrich_places(table):
    df = table("l f full city st tax a z health_system health_system_city", ("Doe", "J", "", "Edina", "MN", "Family Medicine and more words", "", "", "", ""), ("", "", "Roe, Al B MD", "", "", "", "", "", "", ""), ("Poe", "K", "", "", "", "", "", "", "set", "S"))
    query = labelling.name_query("l", "f", "full", "city", "st", "tax")
    assert [r[0] for r in df.orderBy("_ord").select(query).collect()] == [
        "J Doe Family Medicine and Edina MN physician", "Al Roe physician", "K Poe physician"]
    places = df.sparkSession.createDataFrame(
        [("J Doe Family Medicine and Edina MN physician", "Lake Clinic", ["x"], "x", "1 A, Edina, MN 5, USA"), ("Al Roe physician", "Sunny Apartments", ["x"], "x", ""), ("K Poe physician", "Hill Clinic", ["x"], "x", "")],
        "query_key string, name string, types array<string>, primary_type string, formatted_address string")
    got = labelling.enrich_places(df, places, query, "city")
    assert rows_of(got, "_ord", "health_system", "health_system_city") == [(0, "Lake Clinic", "Edina"), (1, "", ""), (2, "set", "S")]
    assert [r[0] for r in df.sparkSession.createDataFrame([("P.O. Box 5", "Edina", "55")], "a string, c string, z string").select(labelling.address_query("a", "c", "z")).collect()] == ["clinic hospital Edina 55"]


def test_label_summary(table):
    df = table("health_system health_system_city", ("a", "edina"), ("a", "EDINA "), ("a", "anoka"), ("b", ""), ("Solo Practice", "x"), ("", "y"))
    assert [tuple(r) for r in labelling.label_summary(df).collect()] == [("a", 3, 2, "Anoka, Edina"), ("b", 1, 0, "")]
    assert labelling.label_summary(df, top=1).count() == 1


# --- address status ----------------------------------------------------------------------------


def test_address_status(either, table):
    refs = table(
        "npi l f m a c z s", ("1", "Doe", "Jane", "", "1 Oak Street", "Edina", "5", "MN"), ("1", "Doe", "Jane", "Q", "1 Oak St.", "Edina", "5", "MN"), ("2", "Roe", "K", "", "1 A", "X", "5", "MN"),
        ("3", "Roe", "K", "", "2 B", "X", "5", "MN"), ("4", "Poe", "L", "", "1 A", "X", "5", "MN"), ("4", "Poe", "L", "", "2 B", "Y", "5", "IA"), ("", "Moe", "M", "A", "1", "X", "5", ""), ("", "Moe", "M", "B", "1", "X", "5", ""))
    mailing = table("npi a b full", ("", "Doe", "Jane", "Jane A Doe"), ("", "Roe", "K", "K Q Roe"), ("", "Poe", "L", "L Q Poe"), ("", "Moe", "M", "M Q Moe"), ("", "Zed", "Z", "Z Zed"), ("2", "x", "x", "x"))
    sets = [("a", "c", "z", "s")]
    ref_names = names.name_variants("l", "f")
    got = classifying.address_status(mailing, refs, names.fullname_variants("full", 3), ref_names, sets, "npi", "m")
    assert rows_of(got, "_ord", "address_status", "address_count", "addresses_found") == [
        (0, "same_address_variant", 2, "1 oak street|edina|5 | 1 oak st.|edina|5"), (1, "name_collision_different_people", 2, "NPIs: 2 | 3"),
        (2, "multiple_addresses", 2, "1 a|x|5 | 2 b|y|5"), (3, "name_collision_different_people", 2, "NPIs: no NPI"), (4, "not_in_originals", 0, ""), (5, "not_in_originals", 0, "")]
    two = classifying.address_status_round2(mailing, refs, "npi", names.round2_name_keys("a", "b"), ref_names, sets, "npi", "m")
    assert rows_of(two, "_ord", "address_status", "address_count", "addresses_found", "_match_method") == [
        (0, "unique", 1, "1 oak street|edina|5", "name"), (1, "name_collision_different_people", 2, "NPIs: 2 | 3", "name"), (2, "unique", 1, "1 a|x|5", "name"),
        (3, "name_collision_different_people", 2, "NPIs: no NPI", "name"), (4, "not_in_gold", 0, "", "none"), (5, "unique", 1, "1 a|x|5", "npi")]
