import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.operators import cleaning
from rollbook.sources import columns, crosswalk, tables


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_read_delimited(spark, tmp_path):
    raw = "﻿ last_name ,primary_postal_code,n\n\"O'Neil, \"\"Bo\"\"\",55401-1234,007\nDoe,,\n"
    got = tables.read_delimited(spark, write(tmp_path / "a.csv", raw))
    assert got.columns == ["last_name", "primary_postal_code", "n", "zip5"]
    assert rows_of(got, *got.columns) == [("Doe", "", "", ""), ("O'Neil, \"Bo\"", "55401-1234", "007", "55401")]


def test_encoding_and_line_ends_are_probed_over_the_whole_text(spark, tmp_path):
    latin = write(tmp_path / "l.csv", ("a\n" + "x\n" * 5000).encode() + "José\n".encode("latin-1"))
    assert tables.probe(spark, latin) == ("ISO-8859-1", False)
    assert tables.read_delimited(spark, latin).where("a = 'José'").count() == 1
    multi = write(tmp_path / "m.csv", 'a,b\n"two\nlines",é\n')
    assert tables.probe(spark, multi) == ("UTF-8", True)
    assert rows_of(tables.read_delimited(spark, multi), "a", "b") == [("two\nlines", "é")]


def test_read_union_and_merge(spark, tmp_path):
    one = write(tmp_path / "one.csv", "last_name,first_name,zip5\nDoe,Jo,55401\nRoe,K,1\n")
    two = write(tmp_path / "two.csv", "Last,first_name,extra,zip5\ndoe,JO,x,55401\n")
    got = tables.read_union(spark, [one, two], {"Last": "last_name"})
    assert rows_of(got, "last_name", "extra", "source_file") == [("Doe", "", "one.csv"), ("Roe", "", "one.csv"), ("doe", "x", "two.csv")]
    assert [r["last_name"] for r in got.orderBy("_ord").collect()] == ["Doe", "Roe", "doe"]
    main, review = cleaning.merge(spark, [one, two], {"Last": "last_name"})
    assert main.count() == 3 and rows_of(review, "last_name", "_dupe_group", "_zip_match") == [("Doe", 1, "Y"), ("doe", 1, "Y")]
    assert cleaning.merge(spark, [one, two], {"Last": "last_name"}, dedup_on="name")[0].count() == 2
    with pytest.raises(ValueError):
        tables.read_union(spark, [])


def test_named_tables(spark, tmp_path, table):
    where = str(tmp_path / "gold")
    parts = {"Matched": table("a", ("1",)), "other": table("a b", ("2", "x")), "empty": table("a")}
    assert tables.write_tables(parts, where) == ["Matched", "other"]
    assert rows_of(tables.read_tables(spark, where), "a", "b", "_source_file", "_source_tab") == [("1", "", "gold", "Matched"), ("2", "x", "gold", "other")]
    assert rows_of(tables.read_tables(spark, where, ["MATCHED"]), "a") == [("1",)]
    assert rows_of(tables.read_tables(spark, where, ["nope"]), "a") == [("1",)]


def test_csv_round_trip_keeps_blanks_quotes_and_spaces(spark, tmp_path, table):
    df = table("a b", (" x ", 'say "hi", ok'), ("", "é"))
    tables.write_tables({"t": df}, str(tmp_path), format="csv")
    assert rows_of(tables.read_delimited(spark, str(tmp_path / "t")), "a", "b") == [(" x ", 'say "hi", ok'), ("", "é")]


def test_read_documents(spark, tmp_path):
    write(tmp_path / "a.txt", "﻿line one\nline two")
    write(tmp_path / "b.txt", b"bad \xff byte")
    write(tmp_path / "c.md", "no")
    got = tables.read_documents(spark, str(tmp_path))
    assert rows_of(got, "file_name", "text") == [("a.txt", "line one\nline two"), ("b.txt", "bad  byte")]


def test_resolve():
    names = ["Last Name", "ZIP", "Clinic Address", "address_1", "city_1", "address_2"]
    assert columns.resolve(names, ["zip5", "zip"]) == "ZIP"
    assert columns.resolve(names, ["clinic_address"]) is None
    assert columns.resolve(names, ["clinic_address"], loose=True) == "Clinic Address"
    assert columns.resolve_or_position(names, ["nope"], 1) == "ZIP"
    assert columns.resolve_roles(names, overrides={"city": "city_1"}) == {"last": "Last Name", "first": None, "zip": "ZIP", "city": "city_1"}
    with pytest.raises(ValueError):
        columns.resolve_roles(names, overrides={"city": "town"})
    assert columns.numbered_address_sets(names) == [("address_1", "city_1", None, None), ("address_2", None, None, None)]
    assert columns.address_sets(["_addr1", "_city", "_mail_addr", "primary_address_1"]) == [("_addr1", "_city", None, None), ("_mail_addr", None, None, None)]
    assert columns.address_sets(["primary_address_1", "zip5", "mn_address_1"]) == [("primary_address_1", None, "zip5", None), ("mn_address_1", None, None, None)]


def test_crosswalk(table):
    df = table("ZIP_CODE CNTY STCOU", ("55401-1", "hennepin", "27-053"), ("55401", "anoka", "27003"), ("55402", "aa", "1001"), ("55402", "bb", "1000")).drop("_ord")
    assert rows_of(crosswalk.load_crosswalk(df), "zip5", "county_name", "county_fips") == [("55401", "Hennepin", "27053"), ("55402", "Aa", "01001")]
    bare = crosswalk.load_crosswalk(df.select("ZIP_CODE"))
    assert bare.where(F.col("county_name") != "").count() == 0 and bare.count() == 2


def test_an_empty_table_replaces_an_older_one(spark, tmp_path):
    from rollbook.sources.tables import write_tables

    full = spark.createDataFrame([("a",)], "x string")
    assert write_tables({"t": full}, str(tmp_path)) == ["t"]
    write_tables({"t": full.limit(0), "u": full.limit(0)}, str(tmp_path))
    assert spark.read.schema("x string").parquet(f"{tmp_path}/t").count() == 0
    assert not (tmp_path / "u").exists()


def test_first_is_first_by_file_however_files_are_packed(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "part-0.csv", "a,n\nfirst,0\n")
    write(folder / "part-1.csv", "a,n\nsecond,1\n" + "".join(f"more,{n}\n" for n in range(2, 5000)))
    got = tables.read_union(spark, [str(folder)]).orderBy("_ord")
    assert [int(r.n) for r in got.select("n").collect()] == list(range(5000))


def test_each_file_has_its_own_encoding_and_quotes(spark, tmp_path):
    folder = tmp_path / "mixed a"
    folder.mkdir()
    write(folder / "a.csv", "name,x\nJosé,1\n")
    write(folder / "b c.csv", "name,x\nJosé,2\n".encode("latin-1"))
    write(folder / "d.csv", 'name,x\n"two\nlines",3\n')
    write(folder / "e.csv", 'name,x\n5" pipe,4\nlast,5\n')
    got = tables.read_delimited(spark, str(folder))
    names = [r[0] for r in rows_of(got, "name", "x")]
    assert names.count("José") == 2 and "two\nlines" in names and len(names) == 5
    kinds = {r.file.rsplit("/", 1)[-1]: (r.broken, r.multi_line) for r in tables._kinds(spark, str(folder)).collect()}
    assert kinds == {"a.csv": (False, False), "b%20c.csv": (True, False), "d.csv": (False, True), "e.csv": (False, True)}


def test_document_text_keeps_genuine_replacement_characters(spark, tmp_path):
    write(tmp_path / "a.txt", b"lost \xff kept \xef\xbf\xbd")
    write(tmp_path / "b.txt", b"kept \xef\xbf\xbd")
    assert rows_of(tables.read_documents(spark, str(tmp_path)), "text") == [("kept \ufffd",), ("lost  kept \ufffd",)]
