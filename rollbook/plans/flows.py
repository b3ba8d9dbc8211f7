"""Whole jobs put together from the operators. Each takes tables and returns named tables, ready for `write_tables`.

Phases that join a table with something computed from itself are stored in the shared folder in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions import names
from rollbook.functions.addresses import address_flags
from rollbook.functions.text import as_column, coalesce_blank, filled, norm
from rollbook.operators import cleaning, comparing, dedup, labelling, matching, reporting, retrieval, survey
from rollbook.scale import stored
from rollbook.sources.columns import numbered_address_sets, resolve, resolve_roles

Tables = dict[str, DataFrame]


def clean_list(df: DataFrame, active_only: bool = False, dedup_on: str = "npi", by_address: bool = False) -> Tables:
    """cleaned, and dropped: the repeated identifiers with the fields in which they differ from the kept row."""
    out = {"cleaned": cleaning.clean(df, active_only, dedup_on, fv.LOCATION_SORT if by_address else None)}
    if dedup_on == "npi" and "npi" in df.columns:
        out["dropped"] = dedup.dropped_report(df, "npi")
    return out


def crossref_lists(
    npi: DataFrame, ext: DataFrame, overrides: Mapping[str, str] | None = None, match_zip: bool = True, match_city: bool = True
) -> Tables:
    """matched, npi_only and external_only; the roster's columns are found by name."""
    parts = matching.crossref(npi, ext, resolve_roles(ext, fv.ROSTER_ROLES, overrides), match_zip, match_city)
    return dict(zip(("matched", "npi_only", "external_only"), parts))


def compare_lists(npi: DataFrame, board: DataFrame, home: str = "MN", order_by: str = "_ord") -> Tables:
    """combined (one row per person, matched or possible), multi_specialty with person status, mn_only, npi_only."""
    left = cleaning.clean(npi, dedup_on="npi", sort_keys=(), order_by=order_by)
    right = cleaning.clean(board, dedup_on="none", sort_keys=(), order_by=order_by)
    six = comparing.compare(left, right, home, order_by)

    def wide(name: str, confidence: str) -> DataFrame:
        table = reporting.pivot_wide(*comparing.split_sources(six[name]), order_by=order_by)
        return table.withColumn("match_confidence", F.lit(confidence))

    combined = wide("matched_1to1", "matched_1to1").unionByName(wide("possible", "possible"), allowMissingColumns=True)
    combined = combined.fillna("", [n for n, t in combined.dtypes if t == "string"])
    order = ("npi_primary_zip", "npi_primary_city", "npi_primary_address_1", "last_name", "first_name")
    return {
        "combined": cleaning.sort_rows(combined, order, None),
        "multi_specialty": comparing.disambiguate(comparing.zip_agreement(six["multi_specialty"])),
        "mn_only": six["right_only"],
        "npi_only": six["left_only"],
        "npi_only_out_of_state": six["left_only_oos"],
    }


def build_gold(df: DataFrame, file_ranks: Mapping[str, int] | None = None, order_by: str = "_ord") -> Tables:
    """gold_reference with coalesced addresses, removed_duplicates, and the rows per source."""
    kept, removed = dedup.dedup_priority(df, file_ranks=file_ranks, order_by=order_by)
    gold = dedup.add_gold_addresses(kept)
    return {"gold_reference": gold, "removed_duplicates": removed, "source_breakdown": reporting.source_breakdown(gold)}


MAILED_COLUMNS = {
    "_check_addr": ("Delivery Address", "primary_address_1", "npi_primary_address_1", "Alternate 1 Address"),
    "_check_city": ("City", "primary_city", "npi_primary_city", "city"),
    "_check_state": ("St", "State", "state", "primary_state"),
    "_check_zip": ("ZIP+4", "zip5", "zip", "Zip", "primary_postal_code", "npi_primary_zip"),
    "_check_npi": ("npi", "NPI"),
    "_check_last": ("last_name", "LastName"),
    "_check_first": ("first_name", "FirstName", "First Name"),
    "_check_fullname": ("FULL NAME", "Full Name", "full_name"),
}


def with_check_columns(df: DataFrame) -> DataFrame:
    """The coalesced _check_* columns of a mailing table."""
    return df.withColumns({n: coalesce_blank(*[c for c in cs if c in df.columns]) for n, cs in MAILED_COLUMNS.items()})


def check_gold_against_mailing(gold: DataFrame, main: DataFrame, addition: DataFrame, removed: DataFrame | None = None) -> Tables:
    """Which people were mailed, by identifier then name, in both directions; mailing rows deduplicated and flagged.

    The order column of the stacked mailing is (0, row) for the addition and (1, row) for the main file.
    """

    def stacked(df: DataFrame, rank: int, label: str) -> DataFrame:
        rows = with_check_columns(df).withColumn("_mailing_source", F.lit(label))
        return rows.withColumn("_ord", F.struct(F.lit(rank).alias("file"), as_column("_ord").alias("row")))

    mailed = stacked(addition, 0, "addition").unionByName(stacked(main, 1, "main"), allowMissingColumns=True)
    mailed = mailed.fillna("", [n for n, t in mailed.dtypes if t == "string"])
    gold_keys = matching.npi_then_name(gold, "npi", "last_name", "first_name")
    mail_keys = matching.npi_then_name(mailed, "_check_npi", "_check_last", "_check_first", "_check_fullname")
    flagged = matching.match_cascade(gold, mailed, gold_keys, mail_keys, "_ord", "in_any_mailing", "mailing_match", "not_mailed")
    reverse = matching.match_cascade(mailed, gold, mail_keys, gold_keys, "_ord", "in_gold", "gold_match")
    missing = reverse.where("not in_gold").drop("in_gold", "gold_match")
    kept, repeated = dedup.dedup_most_complete(mailed, npi="_check_npi", full="_check_fullname", last="_check_last", first="_check_first")
    flags = address_flags("_check_addr", "_check_city", "_check_state", "_check_zip")
    out = {
        "mailed_providers": kept,
        "mailed_duplicates": repeated,
        "bad_addresses": mailed.withColumn("_address_flags", flags).where("_address_flags <> ''"),
        "gold_all_flagged": flagged,
        "not_in_any_mailing": flagged.where("not in_any_mailing"),
        "gold_duplicate_npi": dedup.duplicate_rows(gold, "npi"),
        "main_mailing_not_in_gold": missing.where("_mailing_source = 'main'"),
        "addition_not_in_gold": missing.where("_mailing_source = 'addition'"),
    }
    if removed is not None:
        removed_keys = matching.npi_then_name(removed, "npi", "last_name", "first_name")
        found = matching.match_cascade(removed, mailed, removed_keys, mail_keys, "_ord")
        out["removed_dupes_mailed"] = found.where("in_other").drop("in_other", "match_method")
    counted = {"gold total": gold, "main mailing": main, "addition mailing": addition, "mailed duplicates removed": repeated}
    counted |= {n.replace("_", " "): out[n] for n in ("bad_addresses", "not_in_any_mailing", "gold_duplicate_npi",
                                                      "main_mailing_not_in_gold", "addition_not_in_gold")}
    return {"summary": reporting.check_counts(counted), **out}


def assign_health_systems(
    df: DataFrame,
    overrides: DataFrame | None,
    patterns: Sequence[tuple[str, str, str]],
    reference: DataFrame | None,
    places: DataFrame | None,
    addr1: str = "_check_addr",
    addr2: str | None = "primary_address_2",
    addr3: str | None = "address_line3",
    city: str = "_check_city",
    state: str | None = "_check_state",
    zip_: str = "_check_zip",
    specialty: str | None = None,
) -> Tables:
    """Overrides, organisations and reference table; places by name, then by address; spread over addresses; cleaned."""
    addr2, addr3, state = (c if c in df.columns else None for c in (addr2, addr3, state))
    rows = labelling.assign_label(df, overrides, patterns, reference, addr1, addr2, addr3, city)
    if places is not None:
        query = labelling.name_query("_check_last", "_check_first", "_check_fullname", city, state, specialty)
        rows = stored(labelling.enrich_places(rows, places, query, city), "named-places")
        per = F.concat_ws("|", norm(addr1), norm(city))
        rows = labelling.enrich_places(rows, places, labelling.address_query(addr1, city, zip_), city, per=per)
    rows = labelling.majority_label(stored(rows, "placed"), addr1, city, exclude_noise=False)
    rows = labelling.flag_likely_clinic(rows, addr2, generic=False)
    rows = stored(labelling.clear_noise(rows, extended=False), "health-systems")
    return {"mailed_providers_hs": rows, "health_system_summary": labelling.label_summary(rows, skip_generic=False)}


def reprocess_health_systems(
    df: DataFrame,
    reviews: DataFrame | None,
    overrides: DataFrame | None,
    patterns: Sequence[tuple[str, str, str]],
    addr1: str = "_check_addr",
    addr2: str | None = "primary_address_2",
    city: str = "_check_city",
    note: str = "Opt. Endorsement Line",
) -> Tables:
    """Reviewer notes, noise out, overrides, spreading, generic rows upgraded, the rest labelled by head count."""
    rows = labelling.with_label_columns(df)
    if reviews is not None:
        rows = matching.merge_annotations(rows, reviews, note, last="last_name", first="first_name", addr=addr1, city=city)
    rows = labelling.clear_noise(rows)
    rows = labelling.assign_label(rows, overrides, patterns, None, addr1, addr2, None, city, organisations=False)
    # each of these reads its own input twice, so it is stored in between
    rows = labelling.majority_label(stored(rows, "assigned"), addr1, city)
    rows = labelling.upgrade_generic(stored(rows, "spread"), addr1, city)
    rows = labelling.label_by_count(stored(rows, "upgraded"), addr1, city)
    rows = stored(labelling.flag_likely_clinic(rows, addr2), "reprocessed")
    generic = F.col(labelling.LABEL).isin(fv.SOLO, fv.GROUP)
    return {
        "mailed_providers_hs": rows,
        "health_system_summary": labelling.label_summary(rows),
        "top_health_systems": labelling.label_summary(rows, top=50),
        "solo_group_review": rows.where(generic),
    }


def crossref_manual_list(
    manual: DataFrame, master: DataFrame, last: str, first: str, middle: str | None, addr: str, city: str, zip_: str,
    master_last: str = "last_name", master_first: str = "first_name", master_middle: str | None = "middle_name", slots: int | None = None,
) -> Tables:
    """A hand-collected list, one row per person, looked up in the master list.

    Rows are as wide as `slots`, or as the busiest person where that is not given; `address_slots` has all addresses as rows.
    """
    long = reporting.address_slots(manual, last, first, addr, city, zip_)
    slots = slots or long.agg(F.max("slot")).first()[0] or 0
    wide, dropped = reporting.addresses_wide(manual, last, first, addr, city, zip_, slots=slots)
    own = names.mixed_name_keys(last, first)
    theirs = names.mixed_name_keys(master_last, master_first)
    mid = filled(master_middle) if master_middle else F.lit("")
    shown = F.regexp_replace(F.concat(filled(master_last), F.lit(", "), filled(master_first), F.lit(" "), mid), r"^[\s,]+|[\s,]+$", "")
    found = matching.lookup_first(wide, master.withColumns({"__name": shown, "__mid": mid}), own, theirs, ["__name", "__mid"])
    quality = comparing.match_quality(middle or F.lit(""), F.col("__hit.__mid"))
    rows = found.withColumns({"master_name_match": F.col("__hit.__name"), "match_quality": quality})
    plain = [as_column(c) for c in wide.columns if c != "_norm_key"]
    return {
        "not_in_master": rows.where("__hit is null").select(*plain),
        "matched": rows.where("__hit is not null").select(*plain, "master_name_match", "match_quality"),
        "multiple_address_rows": wide.where("num_addresses > 1").drop("_norm_key"),
        "address_slots": long,
        "dropped_rows": dropped,
        "reconciliation": reporting.reconcile(manual, wide, dropped),
    }


def _address_array(df: DataFrame, sets: Sequence[tuple[str, str | None, str | None, str | None]]) -> Column:
    return cleaning.address_entries(df, sets)


def check_addresses_and_licenses(
    matched: DataFrame, not_matched: DataFrame, mailing: DataFrame, several: DataFrame, board: DataFrame,
    last: str = "last_name", first: str = "first_name", third: str | None = None,
    mailing_addresses: Sequence[tuple[str, str | None, str | None, str | None]] = (),
    several_addresses: Sequence[tuple[str, str | None, str | None, str | None]] = (),
) -> Tables:
    """Addresses of matched people against the mailing list, then the open ones against a list with several addresses;
    people without match are looked up at the license board."""
    own = _address_array(matched, numbered_address_sets(matched))
    keys = names.mixed_name_keys(last, first)
    # the first filled address line of the mailing row is its address
    lines = _address_array(mailing, mailing_addresses)
    one = F.slice(F.filter(lines, lambda e: norm(e["addr"]) != ""), 1, 1)
    against_mailing = matching.compare_addresses(matched, mailing, keys, keys, own, one)
    against_several = matching.second_opinion(
        against_mailing, matching.compare_addresses(matched, several, keys, keys, own, _address_array(several, several_addresses)))
    found, missing = matching.found_and_not(matching.license_lookup(not_matched, board, last, first, third))
    out = {}
    for name, rows in (("mailing", against_mailing), ("several", against_several)):
        for verdict in ("same", "possible_match", "different", "not_found"):
            out[f"{name}_{verdict}"] = rows.where(F.col("address_match") == verdict)
    return {**out, "in_license_board": found, "not_in_license": missing}


def email_lists(sources: Sequence[tuple[DataFrame, str]], board: DataFrame) -> Tables:
    """Unique people of all sources found at the license board, with and without e-mail address."""
    # the key is unique per person, so it serves as the order column of the lookup
    people = dedup.union_first(sources).withColumnRenamed("_key", "_ord")
    # first names are taken as they are: a blank in them does not make them full names
    keys = names.last_first_keys("last_name", "first_name")
    rows = matching.license_lookup(people, board, "last_name", "first_name", keys=keys)
    mail, no_mail = matching.with_and_without_email(rows)
    clean = ("last_name", "first_name", "email", "specialty_boards", "certification", "specialty_boards_missing", "certification_missing")

    def sorted_(df: DataFrame) -> DataFrame:
        return cleaning.sort_rows(df.select(*clean), ("last_name", "first_name"), None, ignore_case=True)

    return {"with_email": mail, "with_email_clean": sorted_(mail), "no_email": no_mail, "no_email_clean": sorted_(no_mail)}


def tabulate_survey(df: DataFrame, order_by: str = "_ord", rules: Sequence[tuple[str, str]] = ()) -> Tables:
    """All survey tables: frequencies of both groups, county, free text and submission times; absent columns are skipped."""
    classes = survey.classify_columns(df, order_by)
    rows = survey.with_group(df)
    freqs = survey.freq_all(rows.drop(order_by), classes)
    elig, inelig = freqs.where("group = 'eligible'").drop("group"), freqs.where("group = 'ineligible'").drop("group")
    record = resolve(df, ["Record ID"])
    keep = [as_column(record).alias("record_id")] if record else []
    out = {"eligible": elig, "ineligible": inelig, "report_counts": survey.report_counts(elig, inelig)}
    if survey.county_columns(df):
        county = survey.county_answers(rows, keep=keep)
        out |= {"county": county, "county_freq": survey.county_table(county), "county_summary": survey.county_summary(county, rules)}
    text = [c for c in classes.free_text if c not in classes.timestamps]
    if text:
        out["free_text"] = survey.free_text_long(rows, text, record)
    if classes.timestamps:
        out["completion_time"] = survey.submission_times(rows, classes.timestamps[0], record or df.columns[0])
    if classes.complete:
        out["completion"] = survey.completion_pivot(elig, inelig)
    return out


def answer_queries(
    titles: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = fv.TOP_K, course: str = "course_name",
    course_vector: str = "course_embedding", lesson: str = "lesson_number",
) -> DataFrame:
    """(query_id, formatted, sources, message) for a table of queries.

    A named course is resolved to the nearest title by its vector, then chunks are searched within course and lesson.
    `titles` has title and embedding; `chunks` has chunk_id, course_title, lesson_number, content and embedding.
    """
    named = queries.where(norm(course) != "")
    asked = named.select("query_id", as_column(course_vector).alias("embedding"))
    resolved = retrieval.resolve_title(titles, asked).select("query_id", F.col("title").alias("course_title"))
    full = queries.join(resolved, "query_id", "left")
    searchable = full.where((norm(course) == "") | F.col("course_title").isNotNull())
    filters = ["course_title", "lesson_number"]
    wanted = searchable.select("query_id", "embedding", "course_title", as_column(lesson).alias("lesson_number"))
    hits = retrieval.search(chunks, wanted, k, filters=filters)
    shown = retrieval.format_hits(hits.join(chunks.drop("embedding"), "chunk_id"))
    messages = retrieval.search_messages(full, hits, course, lesson, "course_title")
    return messages.join(shown, "query_id", "left").select(
        "query_id", F.coalesce("formatted", F.lit("")).alias("formatted"), F.coalesce("sources", F.lit("")).alias("sources"), "message")
