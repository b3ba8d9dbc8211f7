import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.operators import cleaning, dedup


@pytest.fixture
def people(table):
    return table(
        "npi last_name first_name zip5 source_file status",
        ("1000000001", "SMITH Jr.", "mary ann", "55401-1", "a", "A"),
        ("1000000001", "Smith", "Mary Ann", "55401", "b", "a"),
        ("", "Smith", "Mary Ann", "55402", "b", "D"),
        ("", "o'neil-lee", " Bo ", "", "a", "A"),
        (None, None, None, None, "a", None),
        ("12", "Smith", "Mary Ann", "55401", "a", "A"),
    )


def test_clean_normalises_and_keeps_blank_identifiers(people):
    got = cleaning.clean(people)
    assert rows_of(got, "_ord", "npi", "last_name", "zip5") == [
        (0, "1000000001", "Smith Jr.", "55401"), (2, "", "Smith", "55402"), (3, "", "O'Neil-Lee", ""), (4, "", "", ""),
        (5, "12", "Smith", "55401")]
    assert [r["_ord"] for r in cleaning.clean(people, blank_is_key=True).orderBy("_ord").collect()] == [0, 2, 5]


def test_clean_modes(people):
    assert [r["_ord"] for r in cleaning.clean(people, dedup_on="name").orderBy("_ord").collect()] == [0, 3, 4]
    assert [r["_ord"] for r in cleaning.clean(people, dedup_on="name+zip").orderBy("_ord").collect()] == [0, 2, 3, 4]
    assert cleaning.clean(people, active_only=True, dedup_on="none").count() == 4
    with pytest.raises(ValueError):
        cleaning.clean(people, dedup_on="zip")


def test_clean_is_sorted_with_ties_by_order(people):
    got = [r["_ord"] for r in cleaning.clean(people, dedup_on="none").collect()]
    assert got == [4, 3, 1, 2, 5, 0]


def test_dedup_does_not_depend_on_partitioning(people):
    want = rows_of(dedup.dedup_first(people, ["last_name"]), "_ord")
    for n in (1, 3, 8):
        shuffled = people.repartition(n, F.rand(n))
        assert rows_of(dedup.dedup_first(shuffled, ["last_name"]), "_ord") == want


def test_dropped_report(table):
    df = table("npi a b", ("1", "x", "y"), ("1", "x", "y"), ("1", "x", "z"), ("", "p", "q"), ("", "r", "s"), ("1", None, "z"))
    got = rows_of(dedup.dropped_report(df, "npi"), "_ord", "_fields_differing_from_kept")
    assert got == [(1, "(identical)"), (2, "b"), (5, "a, b")]
    assert (4, "a, b") in rows_of(dedup.dropped_report(df, "npi", blank_is_key=True), "_ord", "_fields_differing_from_kept")


@pytest.mark.parametrize("large", [False, True])
def test_flag_duplicates(people, large, request):
    if large:
        request.getfixturevalue("spread")
    got = rows_of(dedup.flag_duplicates(people), "_ord", "_dupe_count", "_dupe_group", "_files_in_group", "_zip_match")
    assert got == [(0, 4, 1, "a, b", "Y"), (1, 4, 1, "a, b", "Y"), (2, 4, 1, "a, b", "N"), (3, 1, 0, "", "N"), (4, 1, 0, "", "N"), (5, 4, 1, "a, b", "Y")]


def test_dedup_priority(table):
    df = table(
        "npi last_name first_name middle_name zip5 _source_tab _source_file",
        ("1000000001", "A", "B", "", "1", "mnonly", "f"), ("1000000001", "A", "B", "", "1", "matched", "f"), ("99", "C", "D", "", "2", "odd", "f"),
        ("", "c", " d", "", "2", "npionly", "f"), ("", "", "", "", "", "matched", "f"), ("", "E", "F", "", "", "x", "g"), ("", "E", "F", "", "", "x", "f"))
    kept, removed = dedup.dedup_priority(df, file_ranks={"f": 0})
    assert rows_of(kept, "_ord") == [(1,), (3,), (6,)]
    assert rows_of(removed, "_ord", "_removed_by", "_dedup_key") == [
        (0, "duplicate_npi", ""), (2, "duplicate_name_zip", "c|d||2"), (4, "duplicate_name_zip", "|||"), (5, "duplicate_name_zip", "e|f||")]


def test_dedup_most_complete(table):
    df = table(
        "npi full last_name first_name x",
        ("1000000001", "", "A", "B", ""), ("100-000-0001", "", "A", "B", "more"), ("", "Doe, Jane Q", "", "", ""), ("", "Jane Doe MD", "", "", "more"),
        ("", "", "Doe", "Jane Ann", "more"), ("", "", "", "x", ""), ("", "", "", "x", ""))
    kept, removed = dedup.dedup_most_complete(df, full="full")
    # the row with the longer list of fields stays, the first one on ties; rows without a key all stay
    assert rows_of(kept, "_ord") == [(1,), (4,), (5,), (6,)]
    assert rows_of(removed, "_ord", "_dedup_key") == [(0, "npi:1000000001"), (2, "name:doe jane"), (3, "name:doe jane")]


def test_union_first(table):
    a = table("Last_Name First_Name", ("Doe MD", "Jane A"), ("", ""))
    b = table("last_name first_name", ("doe", "jane"), ("Roe", "Al"), ("Roe", "Al B"))
    got = dedup.union_first([(a, "one"), (b, "two")])
    assert rows_of(got, "last_name", "source", "_key") == [("Doe MD", "one", "doe|jane"), ("Roe", "two", "roe|al")]


def test_duplicate_rows_ignore_blank(table):
    df = table("npi a b", ("1", "Doe", "J."), (" 1", "doe", "j."), ("", "x", "y"), ("", "Doe", "J."))
    assert rows_of(dedup.duplicate_rows(df, "npi"), "_ord") == [(0,), (1,)]
    assert rows_of(dedup.duplicate_rows(df, dedup.pair_key("a", "b"), "|"), "_ord") == [(0,), (1,), (3,)]


def test_restrict_states(table):
    df = table("a c z s", ("1 A", "E", "5", "MN "), ("2 B", "E", "5", "IA"), ("", "E", "5", "MN"), ("3 C", "E", "5", None))
    got = cleaning.restrict_states(df, [("a", "c", "z", "s")]).select("_ord", F.size("addresses").alias("n"))
    assert rows_of(got, "_ord", "n") == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_reorder_and_sort(people):
    assert cleaning.reorder(people, ("zip5", "nope", "npi")).columns[:3] == ["zip5", "npi", "_ord"]
    got = [r["_ord"] for r in cleaning.sort_rows(people, ["last_name", "nope"], ignore_case=True).collect()]
    assert got == [4, 3, 1, 2, 5, 0]
