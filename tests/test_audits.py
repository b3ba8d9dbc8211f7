"""Whole jobs that hold lists against each other, on a few rows."""

from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.operators import matching
from rollbook.plans import audits


def test_gold_against_reprocessed_takes_names_in_either_order(table):
    gold = table("npi last_name first_name _source_tab", ("1", "Doe", "Jane", "a"), ("", "Roe MD", "Al B", "a"), ("", "Poe", "Ed", "b"), ("9", "", "", "b"), ("", "Lone", "", "b"))
    mailed = table(
        "npi last_name first_name full_name health_system health_system_city",
        ("1", "X", "Y", "", "", ""), ("1", "X", "Y", "", " North ", "Ely"), ("", "Al", "Roe", "", "S", "C"), ("", "", "", "Poe, Ed", "S", "C"), ("", "", "", "Lone", "", ""))
    out = audits.gold_against_reprocessed(gold, mailed)
    assert rows_of(out["all"], "_ord", "_match_method", "_mailed_hs", "_mailed_hs_city") == [
        (0, "npi", "North", "Ely"), (1, "name", "", ""), (2, "name", "", ""), (3, "not_mailed", "", ""), (4, "name", "", "")]
    assert rows_of(out["summary"], "source_tab", "total", "in_mailed", "not_in_mailed") == [("a", 2, 2, 0), ("b", 3, 2, 1)]
    assert out["not_mailed"].count() == 1 and out["in_mailed"].count() == 4


def test_coverage_of_several_tables(table):
    one = table("last_name first_name addr city zip", ("Doe", "Jane", "1 A", "X", "5"), ("Roe", "Al", "2 B", "Y", "5"))
    two = table("last_name first_name addr city zip", ("Zed", "Q", "3 C", "Z", "5"))
    mailing = table("full addr city zip", ("Jane Doe", "", "", ""), ("Someone Else", "2  b", "y", "5"), ("No One", "", "", ""))
    out = audits.mailing_coverage({"one": one, "two": two}, mailing, "last_name", "first_name", [("addr", "city", "zip")], "full", ("addr", "city", "zip"))
    assert rows_of(out["summary"], "tab", "match_method", "n") == [("one", "address", 1), ("one", "name", 1), ("two", "not_found", 1)]
    assert rows_of(out["not_in_mailing"], "last_name") == [("Zed",)] and rows_of(out["mailing_not_in_providers"], "full") == [("No One",)]


def test_duplicates_and_overlap(table):
    a = table("full_name city", ("Jane Doe", "X"), ("Al Roe", "Y"))
    b = table("last_name first_name city", ("Doe", "Jane", "Q"), ("New", "One", "X"))
    out = audits.check_duplicates(a, b, matching.roster_names("full_name", None, None), "city", matching.roster_names(None, "last_name", "first_name"), "city")
    assert rows_of(out["duplicates"], "last_name") == [("Doe",)] and rows_of(out["unique"], "last_name") == [("New",)]
    records = table(
        "npi last_name first_name middle_name source", ("1", "A", "B", "", "f1 / t"), ("1", "A", "B", "", "f2 / t"), ("", "C", "D", "Q", "f1 / t"), ("nan", "C", "D", "q.", "f2 / u"))
    addition = table("npi last_name first_name middle_name", ("1", "", "", ""), ("", "c", "d", "Q"), ("", "c", "d", ""), ("nan", "x", "", ""))
    found = audits.check_overlap(records, addition)
    assert rows_of(found["overlap_matrix"], "shared_by_npi", "shared_by_name") == [(1, 1)]
    assert rows_of(found["addition"], "_ord", "match_method") == [(0, "npi"), (1, "name"), (2, "not_found"), (3, "not_found")]
    assert found["missing"].count() == 2 and found["overlap_details"].count() == 2 and found["row_counts"].agg(F.sum("row_count")).first()[0] == 4


def test_several_addresses_in_both_rounds(table):
    originals = table(
        "last_name first_name middle_name npi addr city zip state", ("Doe", "Jane", "", "1", "1 A St", "X", "5", "MN"), ("Doe", "Jane", "", "1", "2 B St", "X", "5", "MN"), ("Roe", "Al", "", "2", "3 C", "Y", "6", "MN"),
        ("Twin", "Ed", "", "3", "4 D", "Z", "7", "MN"), ("Twin", "Ed", "", "4", "4 D", "Z", "7", "MN"))
    mailing = table("full_name npi last first addr city zip", ("Jane Doe", "", "Doe", "Jane", "9 Z", "X", "5"), ("Al Roe", "2", "Roe", "Al", "3 C", "Y", "6"), ("Ed Twin", "", "Twin", "Ed", "", "", ""), ("No One", "", "One", "No", "", "", ""))
    sets = [("addr", "city", "zip", None)]
    own = names.name_variants("last_name", "first_name")
    one = audits.multiple_addresses(mailing, originals, names.fullname_variants("full_name", 2), own, sets, ["full_name"], ("addr", "city", "zip"), slots=2)
    statuses = [("multiple_addresses", 1), ("name_collision_different_people", 1), ("not_in_originals", 1), ("unique", 1)]
    assert rows_of(one["summary"], "address_status", "n") == statuses
    assert rows_of(one["compare"], "full_name", "mail_address", "num_addresses", "gold_addr_1", "gold_addr_2") == [("Jane Doe", "9 Z", 2, "1 a st", "2 b st")]
    assert rows_of(one["addresses"], "slot", "addr") == [(1, "1 a st"), (2, "2 b st")] and one["name_collisions"].count() == 1
    two = audits.multiple_addresses_round2(
        mailing, originals, "npi", names.round2_name_keys("last", "first"), own, [("addr", "city", "zip", "state")], ["full_name"], ("addr", "city", "zip"))
    assert rows_of(two["method_summary"], "address_status", "_match_method", "n") == [
        ("multiple_addresses", "name", 1), ("name_collision_different_people", "name", 1), ("not_in_gold", "none", 1), ("unique", "npi", 1)]


def test_round_two_check_and_corrections(table):
    df = table("npi last_name first_name a1 a2 st zip", ("1", "Doe", "Jane", "1 A", "", "MN", "5"), ("1", "Doe", "Jane MD", "", "", "", "5"), ("", "", "", "x", "", "MN", ""))
    out = audits.check_round2(df, ["a1", "a2"], "st", "zip")
    assert rows_of(out["address_issues"], "_ord", "_issues") == [(1, "missing_address|missing_state"), (2, "missing_zip")]
    assert out["duplicate_npi"].count() == 2 and out["duplicate_name"].count() == 2
    assert rows_of(out["issue_breakdown"], "flag", "n") == [("missing_address", 1), ("missing_state", 1), ("missing_zip", 1)]
    fixes = table("last_name first_name a1 zip", ("doe", "jane", "1 a", "99"), ("No", "One", "5 E", ""))
    done = audits.postal_corrections(df, fixes, {"a1": "a1", "zip": "zip"}, silent=("zip",))
    assert rows_of(done["summary"], "check", "count") == [("not_found", 1), ("updated", 0)]
    assert rows_of(done["corrected"], "_ord", "a1", "zip")[0] == (0, "1 A", "99")


def test_health_systems_ranked_and_compared(table):
    df = table("primary_address_1 zip5", ("1 A", "55401"), ("1  a", "55401-2"), ("2 B", "5"), ("3 C", "6"))
    labelled = table("primary_address_1 zip5 health_system health_system_city", ("1 a", "55401", "", ""), ("1 A", "55401", "North", "Ely"), ("2 b", "5", "South", ""))
    ranked = audits.rank_health_systems(df, labelled)
    assert rows_of(ranked["ranked"], "rank", "health_system", "total_providers", "cities") == [(1, "north", 2, "ely (2)"), (2, "south", 1, "(unknown) (1)")]
    assert ranked["unmatched"].count() == 1
    other = table("System Clinic_City", ("NORTH", "Ely"), ("North", "Duluth"), ("East", "X"), ("", "X"))
    got = audits.compare_health_systems(df, labelled, other)
    assert rows_of(got["systems"], "health_system", "round3_providers", "dup_providers", "status") == [("east", 0, 1, "only_in_b"), ("north", 2, 2, "in_both"), ("south", 1, 0, "only_in_a")]
    assert rows_of(got["locations_in_both"], "health_system", "health_system_city", "dup_providers") == [("north", "ely", 1)]
    assert got["locations_only_in_b"].count() == 2
