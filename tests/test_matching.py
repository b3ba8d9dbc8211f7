import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.functions import names
from rollbook.operators import comparing, matching


@pytest.fixture(params=[False, True], ids=["small", "spread"])
def either(request):
    """Run a test with the plain plans and with those for large data."""
    if request.param:
        request.getfixturevalue("spread")


@pytest.fixture
def left(table):
    return table(
        "npi last_name first_name zip5 primary_city",
        ("1", "Smith Jr.", "Mary Ann", "55401-9", "Edina"), ("2", "Smith", "Mary Ann", "1", "EDINA"), ("", "Doe", "Jo", "2", "Anoka"), ("", "", "", "3", "x"),
        ("9", "Whiting Allen", "Kaeley", "", ""))


@pytest.fixture
def right(table):
    return table(
        "npi last first zip city full",
        ("1", "SMITH", "mary ann", "55401", "nowhere", "Mary Ann Smith"), ("7", "Smith", "Mary  Ann", "9", "edina", "Smith, Mary Ann"), ("", "", "", "3", "x", ""),
        ("8", "Kaeley", "Kaeley Whiting Allen", "", "", "Kaeley Whiting Allen"))


ROLES = {"last": "last", "first": "first", "zip": "zip", "city": "city"}


def test_crossref_partitions_both_sides(either, left, right):
    matched, left_only, right_only = matching.crossref(left, right, ROLES)
    # ZIP first: 0 meets 0; then the city: 1 meets 1, and 0 and its partner are out of the second round
    assert rows_of(matched, "_ord", "ext__ord") == [(0, 0), (1, 1)]
    assert rows_of(left_only, "_ord") == [(2,), (3,), (4,)]
    assert rows_of(right_only, "_ord") == [(2,), (3,)]


def test_crossref_nameless_rows_only_on_request(left, right):
    matched, _, _ = matching.crossref(left, right, ROLES, require_name=False)
    assert (3, 2) in rows_of(matched, "_ord", "ext__ord")


def test_match_cascade_prefers_the_first_kind(either, left, right):
    flagged = matching.match_cascade(
        left, right, matching.npi_then_name(left, "npi", "last_name", "first_name"), matching.npi_then_name(right, "npi", "last", "first", "full"))
    assert rows_of(flagged, "_ord", "in_other", "match_method") == [
        (0, True, "npi"), (1, True, "name"), (2, False, "not_found"), (3, False, "not_found"), (4, True, "name")]


def test_coverage_by_address(table):
    providers = table("l f a c z a2 c2 z2", ("Doe", "J", "1 A St", "Edina", "55401", "", "", ""), ("Roe", "K", "", "", "", "2 B", "Anoka", "5"), ("Poe", "L", "", "", "", "", "", ""))
    mailing = table("full a c z", ("Xu Li", "1  a st", "EDINA", "55401-1"), ("Moe", "2 b", "anoka", "5"), ("L Poe", "", "", ""))
    fwd, back = matching.coverage(providers, mailing, "l", "f", [("a", "c", "z"), ("a2", "c2", "z2")], "full", ("a", "c", "z"))
    assert rows_of(fwd, "_ord", "match_method") == [(0, "address"), (1, "address"), (2, "name")]
    assert rows_of(back, "_ord", "match_method") == [(0, "address"), (1, "address"), (2, "name")]


def test_lookup_first_takes_rank_then_order(either, table):
    left = table("l f", ("smith", "mary ann"), ("x", "y"))
    ref = table("l f v", ("smith", "mary", "token"), ("smith", "mary ann", "whole"), ("smith", "mary ann", "later"))
    exact = F.array(F.concat_ws("|", "l", "f"), F.concat_ws("|", "l", F.substring_index("f", " ", 1)))
    got = matching.lookup_first(left, ref, exact, F.array(F.concat_ws("|", "l", "f")), ["v"])
    assert rows_of(got.select("_ord", F.col("__hit.v").alias("v")), "_ord", "v") == [(0, "whole"), (1, None)]


def test_license_lookup_prefers_exact_names(table):
    left = table("last_name first_name third", ("Smith", "Mary", ""), ("Smith", "M", ""), ("Zed", "Q", ""), ("Mary", "A", "Smith"))
    board = table(
        "last_name first_name specialty_boards certification email", ("Smith", "Max", "", "c0", ""), ("Smith", "Mary", "Surgery", "", "m@x"))
    got = matching.license_lookup(left, board)
    assert rows_of(got, "_ord", "match_type", "license_name_match", "specialty_boards_missing", "certification_missing") == [
        (0, "exact", "Smith, Mary", "", "missing"), (1, "initial_match", "Smith, Max", "missing", ""), (2, "", "", "", ""), (3, "", "", "", "")]
    by_third = matching.license_lookup(left, board, third="third")
    assert rows_of(by_third, "_ord", "match_type")[3] == (3, "exact")
    found, missing = matching.found_and_not(got)
    assert (found.count(), missing.count()) == (2, 2)
    mail, no_mail = matching.with_and_without_email(got)
    assert (rows_of(mail, "_ord"), rows_of(no_mail, "_ord")) == ([(0,)], [(1,)])


def test_apply_corrections(either, table):
    df = table("last_name first_name a1 a2 city st", ("Doe", "J", "1 A", "", "X", "MN"), ("Doe", "J", "1 A", "", "X", "MN"), ("Roe", "K", "2 B", "", "Y", "MN"))
    fix = table("last_name first_name a1 a2 city st", ("DOE", "j", "9 Z", "", "x ", "WI"), ("Roe", "K", "2  b", "", "", "IA"), ("Moe", "L", "1", "", "", ""), ("doe", "J", "8 Y", "", "", ""))
    fields = {"a1": "a1", "a2": "a2", "city": "city", "st": "st"}
    rows, missing = matching.apply_corrections(df, fix, fields, line2="a2", silent=("st",))
    assert rows_of(rows, "_ord", "a1", "city", "st", "address_updated") == [
        (0, "1 A", "X", "MN", ""), (1, "8 Y", "X", "WI", "Y"), (2, "2 B", "Y", "IA", "")]
    assert rows_of(missing, "_ord") == [(2,)]


def test_merge_annotations(table):
    df = table(
        "npi last_name first_name primary_address_1 primary_city health_system health_system_city note",
        ("1", "A", "B", "1 X", "Edina", "", "", ""), ("1", "A", "B", "1 X", "Edina", "", "", ""), ("", "C", "D", "2 Y", "Anoka", "Old", "Town", "mine"),
        ("", "", "", "", "", "Keep", "K", "Suite 5"))
    reviews = table(
        "npi last_name first_name primary_address_1 note", ("1", "", "", "", ""), ("1", "", "", "", "SOLO "), ("1", "", "", "", "late"), ("", "c", "d", "2 y", "theirs"))
    got = matching.merge_annotations(df, reviews, "note")
    assert rows_of(got, "_ord", "health_system", "health_system_city", "_user_reviewed") == [
        (0, "", "", ""), (1, "Solo Practice", "Edina", "yes"), (2, "mine", "Town", "yes"), (3, "Keep", "K", "")]


def test_compare_addresses(table):
    def entry(a, c, z):
        return F.struct(F.col(a).alias("addr"), F.col(c).alias("city"), F.col(z).alias("zip"))

    left = table("l f a c z", ("Doe", "J", "1026 W First St.", "Saint Paul", "55401"), ("Roe", "K", "12 Oak Street", "Edina", "55401"), ("Poe", "L", "99 Elm", "Q", "1"), ("Zoe", "M", "", "", ""))
    ref = table("l f a c z", ("doe", "j", "1026 1st Street W", "St. Paul", "55401-2"), ("roe", "k", "14 Oak Street", "Edina", "55401"), ("poe", "l", "5 Main Parkway Suite 9", "Edina", "55401"), ("Yoe", "M", "1", "", ""))
    keys = names.mixed_name_keys("l", "f")
    got = matching.compare_addresses(left, ref, keys, keys, F.array(entry("a", "c", "z")), F.array(entry("a", "c", "z")))
    assert rows_of(got, "_ord", "address_match") == [(0, "same"), (1, "possible_match"), (2, "different"), (3, "not_found")]
    assert rows_of(matching.second_opinion(got, got), "_ord") == [(1,), (2,), (3,)]


def test_add_titles_and_columns_follow_their_own_first_row(table):
    df = table("last_name first_name", ("Doe", "J"), ("", ""), ("Roe", "K"))
    one = table("last_name first_name credential", ("doe", "j", ""), ("Doe", "J", "RN"), ("", "", "MD"))
    two = table("last_name first_name credential taxonomy_descriptions", ("DOE", "J", "MD", "Family Medicine, Geriatrics"), ("Roe", "K", "x", "Surgery"))
    # titles: first row that has a credential; columns: first row of the name
    assert rows_of(matching.add_titles(df, [one, two], ["credential"]), "_ord", "title") == [(0, "RN"), (1, ""), (2, "")]
    got = matching.add_columns(df, [one, two], ["credential"])
    assert rows_of(got, "_ord", "title", "specialty", "subspecialty") == [(0, "", "", ""), (1, "", "", ""), (2, "", "Surgery", "")]


def test_six_way_comparison(either, table):
    columns = "last_name first_name middle_name primary_state primary_address_1 zip5 license_type_desc"
    npi = table(columns, *[(l, f, m, s, "1 A", "1", "") for l, f, m, s in (
        ("One", "A", "Q", "MN"), ("Many", "B", "", "MN"), ("Maybe", "C", "X", "MN"), ("Home", "D", "", "mn"), ("Away", "E", "", "IA"), ("One", "A", "Z", "MN"))])
    mn = table(columns, *[(l, f, m, s, a, "1", t) for l, f, m, s, a, t in (
        ("One", "A", "Q.", "MN", "1", "x"), ("Many", "B", "", "MN", "1", "x"), ("Many", "B", "", "MN", "2", "x"), ("Maybe", "C", "", "MN", "1", "x"),
        ("Board", "F", "", "MN", "1", "MD"), ("Board", "F", "", "MN", "1", "md"), ("Board", "F", "", "MN", "1", "DO"), ("Far", "G", "", "WI", "1", "x"))])
    out = comparing.compare(npi, mn)
    assert {k: rows_of(v, "_source_type", "last_name", "middle_name") for k, v in out.items()} == {
        "matched_1to1": [("MN", "One", "Q."), ("NPI", "One", "Q")],
        "multi_specialty": [("MN", "Many", ""), ("MN", "Many", ""), ("NPI", "Many", "")],
        "right_only": [("MN", "Board", "")],
        "left_only": [("NPI", "Home", "")],
        "left_only_oos": [("NPI", "Away", "")],
        "possible": [("MN", "Maybe", ""), ("NPI", "Maybe", "X")],
    }
    assert rows_of(out["right_only"], "license_type_desc", "_mn_specialty_count") == [("MD | DO", 3)]


def test_person_status(table):
    npi = table("last_name first_name zip5 mailing_postal_code credential", ("A", "B", "1", "2", "MD"), ("C", "D", "5", "", ""))
    mn = table(
        "last_name first_name zip5 license_type_desc", ("a", "b", "2", ""), ("a", "b", "9", "Medical Doctor"), ("a", "b", "9", "RN"), ("C", "D", "9", "RN"), ("E", "F", "1", "RN"))
    key = names.name_key("last_name", "first_name")
    both = npi.withColumns({"_source_type": F.lit("NPI"), "_name_key": key}).unionByName(
        mn.withColumns({"_source_type": F.lit("MN"), "_name_key": key}), allowMissingColumns=True)
    got = comparing.disambiguate(comparing.zip_agreement(both)).where("_source_type = 'MN'")
    assert rows_of(got, "_ord", "_npi_address_match", "_person_status") == [
        (0, "matches_npi_mailing_zip", "same_person_zip_match"), (1, "", "same_person_credential_match"), (2, "", "likely_different_person"), (3, "", "unclear"), (4, "", "unclear")]


def test_supplement_shapes_rows_to_the_gold_table(table):
    gold = table("last_name first_name _addr1 extra", ("A", "B", "1", "x")).drop("_ord")
    missing = table("full addr", ("Doe, Jane Q MD", " 5 Elm "), ("", "6"))
    got = matching.supplement(gold, missing, "full", "addr")
    assert rows_of(got, "last_name", "first_name", "_addr1", "extra") == [("A", "B", "1", "x"), ("doe", "jane", "5 Elm", "")]


def test_cascade_ranks_kinds_before_a_long_list_of_keys(spark):
    from pyspark.sql import functions as F

    from rollbook.operators.matching import match_cascade

    left = spark.createDataFrame([(0, [f"n{i}" for i in range(1500)], ["x"])], "_ord long, npi array<string>, name array<string>")
    right = spark.createDataFrame([(0, ["n1400"], ["x"])], "_ord long, npi array<string>, name array<string>")
    keys = {"npi": F.col("npi"), "name": F.col("name")}
    assert [r.match_method for r in match_cascade(left, right, keys, keys).collect()] == ["npi"]
