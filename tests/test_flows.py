import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.plans import flows
from rollbook.sources.tables import read_tables, write_tables

NPI = "npi last_name first_name middle_name primary_state primary_address_1 primary_city zip5 credential"


@pytest.fixture
def npi(table):
    return table(
        NPI, ("1", "DOE", "JANE", "Q", "MN", "1 Oak Street", "EDINA", "55401", "MD"), ("1", "Doe", "Jane", "", "MN", "1 Oak St", "Edina", "55401", "MD"),
        ("2", "Roe", "Al", "", "MN", "2 Elm", "Anoka", "55303", "RN"), ("3", "Poe", "Ed", "X", "MN", "3 Fir", "Edina", "55401", ""), ("4", "Loe", "Bo", "", "MN", "4", "Edina", "1", ""))


def test_clean_list(npi):
    out = flows.clean_list(npi)
    assert out["cleaned"].count() == 4
    assert rows_of(out["dropped"], "_ord", "_fields_differing_from_kept") == [(1, "last_name, first_name, middle_name, primary_address_1, primary_city")]


def test_compare_lists(npi, table):
    board = table(
        "last_name first_name middle_name primary_state primary_address_1 primary_city zip5 license_type_desc",
        ("Doe", "Jane", "Q.", "MN", "9 Home", "Edina", "55401", "Medical Doctor"), ("Roe", "Al", "", "MN", "9", "Anoka", "55303", "RN"), ("Roe", "Al", "", "MN", "8", "Anoka", "1", "DO"),
        ("Poe", "Ed", "", "MN", "7", "Edina", "1", "RN"), ("Zoe", "M", "", "MN", "6", "Edina", "1", "RN"))
    out = flows.compare_lists(npi, board)
    assert rows_of(out["combined"], "last_name", "match_confidence", "mn_address_1", "license_type_desc") == [
        ("Doe", "matched_1to1", "9 Home", "Medical Doctor"), ("Poe", "possible", "7", "RN")]
    status = out["multi_specialty"].where("_source_type = 'MN'")
    assert rows_of(status, "primary_address_1", "_person_status") == [("8", "likely_different_person"), ("9", "same_person_zip_match")]
    assert rows_of(out["mn_only"], "last_name") == [("Zoe",)] and rows_of(out["npi_only"], "last_name") == [("Loe",)]


def test_gold_and_mailing(spark, tmp_path, npi, table):
    where = str(tmp_path / "lists")
    write_tables({"matched": npi.where("npi <> '4'").drop("_ord"), "other": npi.where("npi in ('1', '4')").drop("_ord")}, where)
    gold = flows.build_gold(read_tables(spark, where), order_by="_ord")
    assert gold["gold_reference"].count() == 5  # identifiers are not ten digits, so people are told apart by name and ZIP
    flagged = gold["gold_reference"].withColumn("_ord", F.xxhash64("last_name"))
    main = table("FULL_NAME x", ("a", "b")).select("_ord", F.lit("Roe, Al").alias("FULL NAME"), F.lit("5 Oak").alias("Delivery Address"))
    addition = table("npi last_name first_name primary_address_1 City St zip5", ("1", "Changed", "Name", "1", "Edina", "MN", "55401"), ("", "New", "Person", "", "", "IA", "5"))
    out = flows.check_gold_against_mailing(flagged, main, addition, gold["removed_duplicates"].withColumn("_ord", F.xxhash64("_dedup_key")))
    assert rows_of(out["gold_all_flagged"], "last_name", "mailing_match") == [
        ("DOE", "npi"), ("Doe", "npi"), ("Loe", "not_mailed"), ("Poe", "not_mailed"), ("Roe", "name")]
    assert rows_of(out["addition_not_in_gold"], "last_name") == [("New",)]
    assert rows_of(out["bad_addresses"], "_address_flags")[0][0].startswith("addr_blank")
    counts = dict(rows_of(out["summary"], "check", "count"))
    assert counts["main mailing"] == 1 and counts["addition not in gold"] == 1


def test_health_systems(table):
    df = table(
        "_check_addr primary_address_2 _check_city _check_state _check_zip _check_last _check_first _check_fullname npi last_name first_name",
        ("1 Oak St Ste 1", "", "Edina", "MN", "5", "Doe", "J", "", "1", "Doe", "J"), ("1 Oak St Ste 2", "", "Edina", "MN", "5", "Roe", "K", "", "2", "Roe", "K"),
        ("7 Fir", "Suite 3", "Anoka", "MN", "5", "Poe", "L", "", "3", "Poe", "L"), ("Suite 9", "", "Anoka", "MN", "5", "Moe", "M", "", "4", "Moe", "M"))
    overrides = table("address label city", ("1 oak st ste 1", "Oak Health", "Edina")).drop("_ord")
    places = df.sparkSession.createDataFrame(
        [("L Poe Anoka MN physician", "Fir Clinic", ["x"], "x", "a, Anoka, MN, USA")],
        "query_key string, name string, types array<string>, primary_type string, formatted_address string")
    out = flows.assign_health_systems(df, overrides, [], None, places)
    assert rows_of(out["mailed_providers_hs"], "npi", "health_system") == [("1", "Oak Health"), ("2", "Oak Health"), ("3", "Fir Clinic"), ("4", "")]
    reviews = table("npi note", ("2", "Elm Health")).withColumnRenamed("note", "Opt. Endorsement Line")
    again = flows.reprocess_health_systems(out["mailed_providers_hs"], reviews, None, [])
    assert rows_of(again["mailed_providers_hs"], "npi", "health_system") == [("1", "Oak Health"), ("2", "Elm Health"), ("3", "Fir Clinic"), ("4", "Solo Practice")]
    assert rows_of(again["health_system_summary"], "health_system", "provider_count") == [("Elm Health", 1), ("Fir Clinic", 1), ("Oak Health", 1)]


def test_manual_list_then_addresses_and_licenses(table):
    manual = table("last first mid addr city zip", ("Doe", "Jane", "Q", "1 Oak Street", "Edina", "55401"), ("Doe", "Jane", "Q", "2 Elm", "Edina", "55401"), ("Zed", "Al", "", "3", "X", "1"))
    master = table("last_name first_name middle_name addr city zip", ("Doe", "Jane", "Quinn", "1 Oak St.", "Edina", "55401"))
    out = flows.crossref_manual_list(manual, master, "last", "first", "mid", "addr", "city", "zip")
    assert rows_of(out["matched"], "last", "num_addresses", "master_name_match", "match_quality") == [("Doe", 2, "Doe, Jane Quinn", "exact")]
    assert rows_of(out["not_in_master"], "last") == [("Zed",)] and out["reconciliation"].first()["difference"] == 0
    board = table("last_name first_name specialty_boards certification email", ("Zed", "Al", "S", "", "z@x"))
    named = {"last": "last_name", "first": "first_name"}
    checks = flows.check_addresses_and_licenses(
        out["matched"].withColumnsRenamed(named), out["not_in_master"].withColumnsRenamed(named), master, master, board,
        mailing_addresses=[("addr", "city", "zip", None)], several_addresses=[("addr", "city", "zip", None)])
    assert checks["mailing_same"].count() == 1 and checks["several_same"].count() == 0
    assert rows_of(checks["in_license_board"], "last_name", "email") == [("Zed", "z@x")]


def test_email_lists(table):
    board = table("last_name first_name specialty_boards certification email", ("Zed", "Al", "S", "", "z@x"), ("Doe", "J", "", "", ""))
    out = flows.email_lists([(table("last_name first_name", ("Zed", "Al B"), ("Doe", "Jo")), "one"), (table("Last_Name First_Name", ("zed", "al")), "two")], board)
    assert rows_of(out["with_email_clean"], "last_name", "first_name", "email") == [("Zed", "Al B", "z@x")]
    assert rows_of(out["no_email"], "last_name", "source") == [("Doe", "one")]


def test_crossref_lists(npi, table):
    ext = table("Surname FNAME Zip City", ("doe", "jane", "55401", ""))
    out = flows.crossref_lists(npi, ext)
    assert out["matched"].count() == 2 and out["npi_only"].count() == 3 and out["external_only"].count() == 0


def test_tabulate_survey(spark):
    df = spark.createDataFrame(
        [(0, "r0", "2026-01-05 10:30", "yes", "A", "Ramsey", "Complete"), (1, "r1", "2026-01-05 10:30", "no", "B", "Ramsey", "Complete")],
        ["_ord", "Record ID", "Unnamed: 1", "Do you provide prenatal care", "What is your profession?", "What is the county of your practice?", "Form Complete?"])
    out = flows.tabulate_survey(df)
    assert {n: t.count() for n, t in out.items()} == {
        "eligible": 4, "ineligible": 4, "report_counts": 1, "county": 2, "county_freq": 2, "county_summary": 1, "completion_time": 2, "completion": 1}


def test_answer_queries(spark):
    titles = spark.createDataFrame([("A", [0.0, 0.0]), ("B", [9.0, 9.0])], "title string, embedding array<float>")
    chunks = spark.createDataFrame(
        [("A_0", "A", 1, "a one", [0.0, 1.0]), ("A_1", "A", 2, "a two", [0.0, 2.0]), ("B_0", "B", None, "b", [0.0, 1.0])],
        "chunk_id string, course_title string, lesson_number int, content string, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, [0.0, 1.9], "aa", [1.0, 0.0], None), (2, [0.0, 0.9], "", None, None), (3, [0.0, 0.0], "bb", [8.0, 8.0], 7)],
        "query_id long, embedding array<float>, course_name string, course_embedding array<float>, lesson_number int")
    got = flows.answer_queries(titles, chunks, queries, k=1)
    assert rows_of(got, "query_id", "formatted", "message") == [
        (1, "[A - Lesson 2]\na two", ""), (2, "[A - Lesson 1]\na one", ""), (3, "", "No relevant content found in course 'bb' in lesson 7.")]
