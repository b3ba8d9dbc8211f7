"""Matching of two tables on derived keys.

Everything is an equality join. The shared kernel works on narrow rows only: a row's keys are exploded as
(order, rank, key), met with a reference reduced to one row per key, and folded back to one hit per row; the hit is
then attached to the wide row by its order value, which is unique and therefore spreads evenly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.addresses import addr_key, strict_addr_key
from rollbook.functions.credentials import boards_or_taxonomy, display_title, first_credential, title_of
from rollbook.functions.labels import canonical_practice, is_bad_label, is_individual_label
from rollbook.functions.names import fullname_variants, mixed_name_keys, name_key, name_variants, parse_full_name
from rollbook.functions.similarity import best_ratio
from rollbook.functions.text import as_column, filled, known, let, norm, norm_name, strip, zip5
from rollbook.scale import keyed_join


# --- kernel ------------------------------------------------------------------------------------


def exploded_keys(df: DataFrame, kinds: Mapping[str, Column], order_by: str, extra: Sequence[str] = ()) -> DataFrame:
    """One narrow row per key: order, kind, rank, key. `kinds` maps a name to an array of keys; blank keys go."""

    def ranked_keys(position: int, kind: str, keys: Column) -> Column:
        return F.transform(
            keys,
            lambda key, at: F.struct(
                F.lit(kind).alias("kind"),
                F.struct(F.lit(position).alias("position"), at.alias("at")).alias("rank"),
                key.alias("key"),
            ),
        )

    ranked = F.concat(*[ranked_keys(i, kind, keys) for i, (kind, keys) in enumerate(kinds.items())])
    rows = df.select(as_column(order_by), *extra, F.explode(ranked).alias("__k"))
    return rows.select(order_by, *extra, "__k.kind", "__k.rank", "__k.key").where(filled("key") != "")


def hits_by_keys(
    left: DataFrame, right: DataFrame, left_keys: Mapping[str, Column], right_keys: Mapping[str, Column], order_by: str
) -> DataFrame:
    """(order, kind) of the best-ranked key each left row shares with the right table."""
    known = exploded_keys(right, right_keys, order_by).select("kind", "key").distinct()
    met = keyed_join(exploded_keys(left, left_keys, order_by), known, ["kind", "key"], "left_semi")
    return met.groupBy(order_by).agg(F.min_by("kind", "rank").alias("__kind"))


def match_cascade(
    left: DataFrame,
    right: DataFrame,
    left_keys: Mapping[str, Column],
    right_keys: Mapping[str, Column],
    order_by: str = "_ord",
    found: str = "in_other",
    method: str = "match_method",
    miss: str = "not_found",
) -> DataFrame:
    """Left rows flagged by membership: the first kind of key that the right table knows, else `miss`."""
    hits = hits_by_keys(left, right, left_keys, right_keys, order_by)
    return left.join(hits, order_by, "left").select(
        *[as_column(c) for c in left.columns],
        F.col("__kind").isNotNull().alias(found),
        F.coalesce("__kind", F.lit(miss)).alias(method),
    )


def npi_then_name(df: DataFrame, npi: str | None, last: str | None, first: str | None, full: str | None = None) -> dict:
    """Key arrays by identifier and by cleaned name; a filled full name takes the place of last and first."""
    number = norm(npi) if npi else F.lit("")
    names = name_variants(last or F.lit(""), first or F.lit(""), cleaned=True)
    if full:
        names = F.when(norm(full) != "", fullname_variants(full, 2, cleaned=True)).otherwise(names)
    return {"npi": F.array(number), "name": names}


def attach_first(
    df: DataFrame, ref: DataFrame, key: Column, ref_key: Column, values: Sequence[str], order_by: str = "_ord"
) -> DataFrame:
    """Left join of columns from the first reference row per key; blank keys meet nothing and misses are ''."""
    reduced = (
        ref.withColumn("__key", ref_key)
        .where(filled("__key") != "")
        .groupBy("__key")
        .agg(F.min_by(F.struct(*values), order_by).alias("__hit"))
    )
    rows = df.withColumn("__key", F.nullif(key, F.lit("")))
    return keyed_join(rows, reduced, ["__key"]).select(
        *[as_column(c) for c in df.columns if c not in values],
        *[F.coalesce(F.col("__hit")[v], F.lit("")).alias(v) for v in values],
    )


def carry_label(
    flagged: DataFrame, ref: DataFrame, npi: str, ref_npi: str, labels: Sequence[str], order_by: str = "_ord",
    method: str = "match_method",
) -> DataFrame:
    """Labels for rows matched by identifier: the first reference row whose leading label is filled."""
    source = ref.where(strip(labels[0]) != "").select(as_column(order_by), as_column(ref_npi), *map(as_column, labels))
    key = F.when(F.col(method) == "npi", norm(npi)).otherwise("")
    return attach_first(flagged, source, key, norm(ref_npi), list(labels), order_by)


def lookup_first(
    left: DataFrame,
    ref: DataFrame,
    keys: Column,
    ref_keys: Column,
    values: Sequence[str],
    order_by: str = "_ord",
    ref_order: str | None = None,
    hit: str = "__hit",
) -> DataFrame:
    """One reference row per left row. Each key stands for its first reference row; the best-ranked key wins, then the
    earlier reference row. Adds a struct (key, rank, values...), null for misses."""
    ref_order = ref_order or order_by
    payload = F.struct(as_column(ref_order).alias("__ref"), *[as_column(v) for v in values])
    table = (
        ref.select(payload.alias("payload"), F.explode(F.array_distinct(ref_keys)).alias("key"))
        .where(filled("key") != "")
        .groupBy("key")
        .agg(F.min_by("payload", "payload.__ref").alias("payload"))
    )
    met = keyed_join(exploded_keys(left, {"key": keys}, order_by), table, ["key"], "inner")
    best = met.groupBy(order_by).agg(
        F.min_by(
            F.struct("key", "rank", *[F.col("payload")[v].alias(v) for v in values]), F.struct("rank", "payload.__ref")
        ).alias(hit)
    )
    return left.join(best, order_by, "left").select(*[as_column(c) for c in left.columns], hit)


# --- two lists ---------------------------------------------------------------------------------


def crossref(
    npi: DataFrame,
    ext: DataFrame,
    roles: Mapping[str, str | None],
    match_zip: bool = True,
    match_city: bool = True,
    require_name: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, left_only, right_only): name+ZIP first, then name+city on what neither side has matched yet.

    Matched rows carry both sides, external columns prefixed `ext_`; every pair of a shared key is kept. Rows whose
    key is blank match nothing; `require_name=False` lets nameless rows meet on ZIP or city alone.
    """

    def role(name: str, normaliser) -> Column:
        return normaliser(roles[name]) if roles.get(name) else F.lit("")

    def keyed(df: DataFrame, last: Column, first: Column, zip_: Column, city: Column) -> DataFrame:
        def key(tail: str) -> Column:
            usable = F.length(F.concat("__l", "__f", tail)) > 0
            if require_name:
                usable = (F.concat("__l", "__f") != "") & (F.col(tail) != "")
            return F.when(usable, F.concat_ws("|", "__l", "__f", tail))

        parts = df.withColumns({"__l": last, "__f": first, "__z": zip_, "__c": city})
        return parts.withColumns({"__zip_key": key("__z"), "__city_key": key("__c")}).drop("__l", "__f", "__z", "__c")

    left = keyed(npi, norm_name("last_name"), norm_name("first_name"), zip5("zip5"), norm_name("primary_city"))
    right = keyed(ext, role("last", norm_name), role("first", norm_name), role("zip", zip5), role("city", norm_name))
    stages = [k for k, on in (("__zip_key", match_zip), ("__city_key", match_city)) if on]
    matched = None
    for key in stages:
        other = "__city_key" if key == "__zip_key" else "__zip_key"
        external = right.select(*[as_column(c).alias(f"ext_{c}") for c in ext.columns], key)
        pairs = keyed_join(left.drop(other), external, [key], "inner").drop(key)
        matched = pairs if matched is None else matched.unionByName(pairs)
        # the keys of both sides, found by one aggregation of narrow rows, take out what has matched
        sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        shared = sides.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l = 1 and r = 1").select(key)
        left, right = keyed_join(left, shared, [key], "left_anti"), keyed_join(right, shared, [key], "left_anti")
    return matched, left.select(*npi.columns), right.select(*ext.columns)


def name_city_keys(names: Column, city: Column) -> Column:
    def paired(x: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.when(x["c"] == "", none).otherwise(F.transform(x["n"], lambda n: F.concat_ws("|", n, x["c"])))

    return let(F.struct(norm(city).alias("c"), names.alias("n")), paired)


def address_keys(sets: Sequence[tuple[Column | str, Column | str, Column | str]]) -> Column:
    """addr|city|zip per address set; sets without an address give no key."""
    return F.array(*[F.when(norm(a) == "", "").otherwise(addr_key(a, c, z)) for a, c, z in sets])


def coverage(
    providers: DataFrame,
    mailing: DataFrame,
    last: str,
    first: str,
    provider_addresses: Sequence[tuple[str, str, str]],
    full: str,
    mailing_address: tuple[str, str, str],
    order_by: str = "_ord",
) -> tuple[DataFrame, DataFrame]:
    """Both directions of a coverage check by name, address, then name+city.

    A name+city hit implies a name hit, so the last kind is never reported; it is kept as the documented last step.
    """
    names = name_variants(last, first)
    cities = F.array(*[norm(c) for _, c, _ in provider_addresses])
    provider_keys = {
        "name": names,
        "address": address_keys(provider_addresses),
        "name_city": let(names, lambda n: F.flatten(F.transform(cities, lambda c: name_city_keys(n, c)))),
    }
    full_names = fullname_variants(full, 3)
    mailing_keys = {
        "name": full_names,
        "address": address_keys([mailing_address]),
        "name_city": name_city_keys(full_names, as_column(mailing_address[1])),
    }
    return (
        match_cascade(providers, mailing, provider_keys, mailing_keys, order_by, "in_mailing_list", "match_method"),
        match_cascade(mailing, providers, mailing_keys, provider_keys, order_by, "in_provider_file", "match_method"),
    )


def roster_names(full: str | None, last: str | None, first: str | None) -> Column:
    if full:
        return fullname_variants(full, 3)
    return name_variants(last or F.lit(""), first or F.lit(""))


def duplicates_between(
    a: DataFrame, b: DataFrame, a_names: Column, a_city: str, b_names: Column, b_city: str, order_by: str = "_ord"
) -> DataFrame:
    """Rows of `b` flagged when their name is in `a`; sharing only an address is no duplicate."""
    return match_cascade(
        b,
        a,
        {"name": b_names, "name_city": name_city_keys(b_names, as_column(b_city))},
        {"name": a_names, "name_city": name_city_keys(a_names, as_column(a_city))},
        order_by,
        "duplicate_of_A",
        "match_method",
        "unique",
    )


def license_keys(last: str, first: str, third: str | None = None) -> Column:
    """Exact keys of every reading of the name columns, then the initial keys."""
    pairs = [(last, first)]
    if third:
        pairs += [(last, third), (third, last), (third, first)]
    arrays = [mixed_name_keys(a, b, initials=True) for a, b in pairs]
    every = arrays[0]
    for extra in arrays[1:]:
        every = F.array_union(every, extra)
    return F.concat(F.filter(every, lambda k: ~k.contains("|~")), F.filter(every, lambda k: k.contains("|~")))


def license_lookup(
    left: DataFrame,
    board: DataFrame,
    last: str = "last_name",
    first: str = "first_name",
    third: str | None = None,
    board_last: str = "last_name",
    board_first: str = "first_name",
    specialty: str = "specialty_boards",
    certification: str = "certification",
    email: str = "email",
    order_by: str = "_ord",
    keys: Column | None = None,
) -> DataFrame:
    """License data by name, exact keys before initial keys.

    Adds license_name_match, match_type (exact, initial_match or ''), specialty_boards, certification, email and the
    two *_missing flags. Rows not found keep '' everywhere; `found_and_not` splits the result.
    """
    ref = board.select(
        as_column(order_by),
        F.array_join(F.array_compact(F.array(*[F.nullif(filled(c), F.lit("")) for c in (board_last, board_first)])), ", ")
        .alias("license_name_match"),
        filled(specialty).alias("specialty_boards"),
        filled(certification).alias("certification"),
        filled(email).alias("email"),
        mixed_name_keys(board_last, board_first, initials=True).alias("__keys"),
    )
    values = ["license_name_match", "specialty_boards", "certification", "email"]
    own = keys if keys is not None else license_keys(last, first, third)
    rows = lookup_first(left, ref, own, F.col("__keys"), values, order_by)
    hit = F.col("__hit")

    def missing(name: str) -> Column:
        return F.when(hit.isNotNull() & (norm(hit[name]) == ""), "missing").otherwise("").alias(f"{name}_missing")

    return rows.select(
        *[as_column(c) for c in left.columns],
        F.coalesce(hit["license_name_match"], F.lit("")).alias("license_name_match"),
        F.when(hit.isNull(), "").when(hit["key"].contains("|~"), "initial_match").otherwise("exact").alias("match_type"),
        *[F.coalesce(hit[v], F.lit("")).alias(v) for v in values[1:]],
        missing("specialty_boards"),
        missing("certification"),
    )


def found_and_not(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("match_type <> ''"), rows.where("match_type = ''")


def with_and_without_email(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found rows with and without an e-mail address; rows that were not found are in neither."""
    found = rows.where("match_type <> ''")
    return found.where(norm("email") != ""), found.where(norm("email") == "")


# --- attaching reference values ----------------------------------------------------------------


def add_county(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """county_name and county_fips by zip5; existing ones are replaced, misses are ''."""
    rows = df.drop("county_name", "county_fips")
    return keyed_join(rows, crosswalk, ["zip5"]).fillna("", ["county_name", "county_fips"])


def address_label_join(
    df: DataFrame,
    labelled: DataFrame,
    addr: str,
    zip_: str,
    ref_addr: str,
    ref_zip: str,
    label: str = "health_system",
    city: str = "health_system_city",
    order_by: str = "_ord",
) -> DataFrame:
    """Normalised label and city of the first labelled row with the same address and ZIP; misses are ''."""

    def key(a: str, z: str) -> Column:
        text = F.concat_ws("|", norm(a), zip5(z))
        return F.when(text == "|", "").otherwise(text)

    ref = labelled.withColumns({label: norm(label), city: norm(city)}).where(F.col(label) != "")
    return attach_first(df, ref, key(addr, zip_), key(ref_addr, ref_zip), [label, city], order_by)


def _stacked(sources: Sequence[DataFrame], columns: Mapping[str, Column | str], order_by: str) -> DataFrame:
    stacked = None
    for rank, df in enumerate(sources):
        part = df.select(
            F.struct(F.lit(rank).alias("source"), as_column(order_by).alias("row")).alias("__order"),
            *[
                (filled(e) if isinstance(e, str) and e in df.columns else F.lit("") if isinstance(e, str) else e).alias(n)
                for n, e in columns.items()
            ],
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def _person_key(last: str, first: str) -> Column:
    key = name_key(last, first)
    return F.when(key == "|", "").otherwise(key)


def add_titles(
    df: DataFrame, sources: Sequence[DataFrame], category_columns: Sequence[str], last: str = "last_name",
    first: str = "first_name", order_by: str = "_ord",
) -> DataFrame:
    """Display title by name from the first source row that has a credential."""
    stacked = _stacked(sources, {c: c for c in (last, first, *category_columns)}, order_by)
    ref = stacked.withColumn("__category", first_credential(category_columns)).where("__category is not null")
    ref = ref.withColumn("title", title_of(F.col("__category")))
    return attach_first(df, ref, _person_key(last, first), _person_key(last, first), ["title"], "__order")


def add_columns(
    df: DataFrame, sources: Sequence[DataFrame], category_columns: Sequence[str], last: str = "last_name",
    first: str = "first_name", boards: str = "specialty boards", certification: str = "certification",
    taxonomy: str = "taxonomy_descriptions", order_by: str = "_ord",
) -> DataFrame:
    """title, specialty and subspecialty by name, all from the first source row: boards first, else taxonomy."""
    wanted = {c: c for c in (last, first, *category_columns, boards, certification, taxonomy)}
    stacked = _stacked(sources, wanted, order_by)
    parsed = boards_or_taxonomy(boards, certification, taxonomy)
    ref = stacked.withColumn("title", display_title(category_columns)).withColumn("__parsed", parsed)
    ref = ref.withColumns({n: F.col("__parsed")[n] for n in ("specialty", "subspecialty")})
    return attach_first(
        df, ref, _person_key(last, first), _person_key(last, first), ["title", "specialty", "subspecialty"], "__order"
    )


def apply_corrections(
    df: DataFrame,
    corrections: DataFrame,
    fields: Mapping[str, str],
    last: str = "last_name",
    first: str = "first_name",
    line2: str | None = None,
    silent: Sequence[str] = (),
    order_by: str = "_ord",
    flag: str = "address_updated",
) -> tuple[DataFrame, DataFrame]:
    """(rows, not_found). Filled corrections overwrite by name; the latest one wins.

    `fields` maps a column of `df` to the correction column. A field is overwritten, and the row flagged 'Y', when a
    correction really differs; any `line2` value counts as a change; `silent` fields are overwritten without flag. Of
    several rows with one name only the last is corrected. `not_found` holds the corrections whose name is unknown.
    """

    def person(a: str, b: str) -> Column:
        return F.concat(norm(a), F.lit(" "), norm(b))

    keyed = df.select(as_column(order_by), person(last, first).alias("__key"), *[as_column(c) for c in fields])
    target = (
        keyed.where(F.trim("__key") != "")
        .groupBy("__key")
        .agg(F.max_by(F.struct(order_by, *fields), order_by).alias("__row"))
        .select("__key", "__row.*")
    )
    fixes = corrections.withColumn("__key", person(last, first))
    aggs = []
    for column, fix in fields.items():
        value = strip(fix)
        aggs += [
            F.max_by(F.when(value != "", value), F.when(value != "", as_column(order_by))).alias(f"__new_{column}"),
            F.min(F.when(value != "", norm(fix))).alias(f"__low_{column}"),
            F.max(F.when(value != "", norm(fix))).alias(f"__high_{column}"),
        ]
    latest = fixes.where(F.trim("__key") != "").groupBy("__key").agg(*aggs)
    met = target.join(latest, "__key", "inner")
    changed = F.lit(False)
    new_values = {}
    for column in fields:
        new, low, high, old = (F.col(f"__new_{column}"), F.col(f"__low_{column}"), F.col(f"__high_{column}"), norm(column))
        differs = new.isNotNull() & ((low != old) | (high != old))
        if column in silent or column == line2:
            new_values[column] = new
            changed = changed | new.isNotNull() if column == line2 else changed
        else:
            new_values[column] = F.when(differs, new)
            changed = changed | differs
    patch = met.select(
        as_column(order_by), *[v.alias(f"__set_{c}") for c, v in new_values.items()],
        F.when(changed, "Y").otherwise("").alias(flag),
    )
    rows = df.drop(flag).join(patch, order_by, "left")
    patched = rows.select(
        *[
            F.coalesce(f"__set_{c}", filled(c)).alias(c) if c in fields else as_column(c)
            for c in df.columns if c != flag
        ],
        F.coalesce(flag, F.lit("")).alias(flag),
    )
    not_found = keyed_join(fixes, target.select("__key"), ["__key"], "left_anti").select(*corrections.columns)
    return patched, not_found


# --- addresses of matched rows -----------------------------------------------------------------


def compare_addresses(
    left: DataFrame,
    ref: DataFrame,
    keys: Column,
    ref_keys: Column,
    addresses: Column,
    ref_addresses: Column,
    order_by: str = "_ord",
    out: str = "address_match",
    name: str = "ref_name",
    ref_name: Column | None = None,
    threshold: float | None = None,
    method: str = "blocks",
) -> DataFrame:
    """same, possible_match, different or not_found for each left row against its looked-up reference row.

    Both address columns are arrays of (addr, city, zip); any left address may meet any reference address. Similarity
    is computed only for rows that were found and have no equal pair, by a method of `seq_ratio`; `lev` stays native.
    """
    limit = fv.FUZZY_THRESHOLD if threshold is None else threshold
    source = ref.select(
        as_column(order_by), ref_keys.alias("__keys"), _strict_keys(ref_addresses).alias("__theirs"),
        (ref_name if ref_name is not None else F.lit("")).alias(name),
    )
    rows = lookup_first(left, source, keys, F.col("__keys"), ["__theirs", name], order_by)
    rows = rows.withColumn("__own", _strict_keys(addresses)).withColumn("__same", F.arrays_overlap("__own", "__hit.__theirs"))
    undecided = F.col("__hit").isNotNull() & ~F.coalesce("__same", F.lit(False))
    best = best_ratio(F.when(undecided, F.col("__own")), F.when(undecided, F.col("__hit.__theirs")), method)
    verdict = (
        F.when(F.col("__hit").isNull(), "not_found")
        .when(F.col("__same"), "same")
        .when(F.col("__best") >= limit, "possible_match")
        .otherwise("different")
    )
    return rows.withColumn("__best", best).select(
        *[as_column(c) for c in left.columns], verdict.alias(out), F.coalesce(F.col("__hit")[name], F.lit("")).alias(name)
    )


def _strict_keys(addresses: Column) -> Column:
    filled_ones = F.filter(addresses, lambda e: norm(e["addr"]) != "")
    return F.transform(filled_ones, lambda e: strict_addr_key(e["addr"], e["city"], e["zip"]))


def second_opinion(first: DataFrame, second: DataFrame, order_by: str = "_ord", out: str = "address_match") -> DataFrame:
    """Rows not confirmed in the first comparison, with the verdict of the second."""
    open_rows = first.where(F.col(out) != "same").select(order_by)
    return second.join(open_rows, order_by, "left_semi")


def merge_annotations(
    df: DataFrame,
    reviews: DataFrame,
    note: str,
    npi: str | None = "npi",
    last: str | None = "last_name",
    first: str | None = "first_name",
    addr: str | None = "primary_address_1",
    city: str | None = "primary_city",
    label: str = "health_system",
    label_city: str = "health_system_city",
    order_by: str = "_ord",
) -> DataFrame:
    """Reviewer notes merged by NPI, else name+address, then accepted as labels.

    Per key the first filled note counts and goes to the last row of that key unless it already has one. A note that
    is neither noise nor a person becomes the label, solo and group texts are unified, and `_user_reviewed` is 'yes'.
    """
    def key(frame: DataFrame) -> Column:
        number = known(npi) if npi and npi in frame.columns else F.lit("")
        l, f, a = (norm(c) if c and c in frame.columns else F.lit("") for c in (last, first, addr))
        name = F.when((F.concat(l, f) != "") & (a != ""), F.concat(F.lit("name:"), F.concat_ws("|", l, f, a)))
        return F.when(number != "", F.concat(F.lit("npi:"), number)).otherwise(name)

    notes = (
        reviews.select(as_column(order_by), key(reviews).alias("__key"), known(note).alias("__note"))
        .where("__key is not null and __note <> ''")
        .groupBy("__key")
        .agg(F.min_by("__note", order_by).alias("__note"))
    )
    target = (
        df.select(as_column(order_by), key(df).alias("__key"))
        .where("__key is not null")
        .groupBy("__key")
        .agg(F.max(order_by).alias(order_by))
    )
    patch = target.join(notes, "__key").select(order_by, "__note")
    own = known(note) if note in df.columns else F.lit("")
    rows = df.join(patch, order_by, "left").withColumn(
        note, F.when(own != "", filled(note) if note in df.columns else own).otherwise(F.coalesce("__note", F.lit("")))
    )
    text = known(note)
    take = (text != "") & ~is_bad_label(note) & ~is_individual_label(note)
    for c in (label, label_city):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    new_city = F.when(take & (norm(label_city) == ""), known(city) if city else F.lit("")).otherwise(filled(label_city))
    columns = list(dict.fromkeys([*df.columns, note, label, label_city]))
    return rows.withColumns(
        {
            label_city: new_city,
            label: F.when(take, canonical_practice(note)).otherwise(filled(label)),
            "_user_reviewed": F.when(take, "yes").otherwise(""),
        }
    ).select(*[as_column(c) for c in columns], "_user_reviewed")


def supplement(
    gold: DataFrame,
    missing: DataFrame,
    full: str,
    addr: str | None = None,
    city: str | None = None,
    zip_: str | None = None,
    source_file: str = "mailing",
    source_tab: str = "not_in_gold",
) -> DataFrame:
    """Append rows that the gold table lacks: names parsed from the full name, shaped to its columns, source tagged."""
    def text(c: str | None) -> Column:
        return strip(c) if c else F.lit("")

    parsed = missing.withColumn("__p", parse_full_name(norm(full))).where("__p.last <> ''")
    shaped = parsed.select(
        F.col("__p.last").alias("last_name"),
        F.col("__p.first").alias("first_name"),
        F.col("__p.middle").alias("middle_name"),
        text(addr).alias("_addr1"),
        text(city).alias("_city"),
        (zip5(zip_) if zip_ else F.lit("")).alias("_zip"),
        F.lit(source_file).alias("_source_file"),
        F.lit(source_tab).alias("_source_tab"),
    )
    kept = shaped.select(*[c for c in shaped.columns if c in gold.columns])
    both = gold.unionByName(kept, allowMissingColumns=True)
    return both.fillna("", [n for n, t in both.dtypes if t == "string"])

