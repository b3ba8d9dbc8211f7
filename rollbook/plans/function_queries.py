"""Column functions over the whole people, board and survey tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions import addresses, credentials, labels, names, questions, similarity, text
from rollbook.plans import sql
from rollbook.plans.inputs import SURVEY_HEADERS, board, people, survey_plain

QUERIES = {}
SQL = {}

LOADERS = {"p": people, "m": board, "v": survey_plain}


def _register(name: str, source: str, key: str, columns: dict, expected: dict) -> None:
    def query(spark, sf_dir):
        return LOADERS[source](spark, sf_dir).select(key, *[e().alias(n) for n, e in columns.items()])

    QUERIES[name] = query
    if expected:
        chosen = ", ".join(f"{e} as {n}" for n, e in expected.items())
        SQL[name] = sql.with_inputs(source, f"select {key}, {chosen} from {source}")


def _lists(name: str, source: str, spark_keys, expected: str) -> None:
    """A function that returns keys: compared as the sorted, joined list."""

    def query(spark, sf_dir):
        keys = F.array_join(F.array_sort(spark_keys()), "; ")
        return LOADERS[source](spark, sf_dir).select("_ord", keys.alias("keys"))

    QUERIES[name] = query
    SQL[name] = sql.with_inputs(
        source,
        "select _ord, coalesce(array_to_string(list_sort(list_distinct(list_filter(keys, lambda k: k is not null))), "
        f"'; '), '') as keys from ({expected})",
    )


_register("b1_norm", "p", "_ord", {"a": lambda: text.norm("last_name"), "b": lambda: text.norm("first_name")},
          {"a": sql.norm("last_name"), "b": sql.norm("first_name")})
_register("b2_norm_name", "m", "_ord", {"a": lambda: text.norm_name("last_name"), "b": lambda: text.norm_name("full_name")},
          {"a": sql.norm_name("last_name"), "b": sql.norm_name("full_name")})
_register("b3_zip5", "p", "_ord", {"z": lambda: text.zip5("primary_postal_code")}, {"z": sql.zip5("primary_postal_code")})
_PHONE = sql.digits("primary_telephone_number")
_register("b4_norm_phone", "p", "_ord", {"phone": lambda: text.norm_phone("primary_telephone_number")}, {
    "phone": f"case when length({_PHONE}) = 10 then substr({_PHONE}, 1, 3) || '-' || substr({_PHONE}, 4, 3) || '-' || "
             f"substr({_PHONE}, 7, 4) else {sql.strip('primary_telephone_number')} end"})
_register("b5_title_case", "m", "_ord", {"a": lambda: text.title_case("last_name"), "b": lambda: text.title_case("primary_city")},
          {"a": sql.title("last_name"), "b": sql.title("primary_city")})
_register("b6_clean_name", "m", "_ord", {
    "stripped": lambda: names.strip_suffix("last_name"), "cleaned": lambda: names.clean_name("full_name"),
    "cleaned_long": lambda: names.clean_name("last_name", long=True)}, {
    "stripped": sql.strip_suffix("last_name"), "cleaned": sql.clean_name("full_name"),
    "cleaned_long": sql.clean_name("last_name", True)})
for _profile in addresses.PROFILES:
    _register(f"b7_norm_addr_{_profile}", "m", "_ord",
              {"addr": lambda p=_profile: addresses.norm_addr("primary_address_1", p)},
              {"addr": sql.norm_addr("primary_address_1", _profile)})
_register("b8_norm_city", "m", "_ord", {p: lambda p=p: addresses.norm_city("primary_city", p) for p in ("round2", "strict")},
          {p: sql.norm_city("primary_city", p) for p in ("round2", "strict")})
_register("b9_base_addr_key", "p", "_ord", {"k": lambda: addresses.base_addr_key("primary_address_1", "primary_city")},
          {"k": sql.base_key("primary_address_1", "primary_city")})
_register("b10_norm_credential", "m", "_ord", {"c": lambda: credentials.norm_credential("license_type_desc")},
          {"c": sql.credential("license_type_desc")})
_register("b11_display_title", "p", "_ord", {"t": lambda: credentials.display_title(["credential", "taxonomy_descriptions"])}, {
    "t": sql.title_of(f"coalesce(nullif({sql.credential('credential')}, ''), "
                      f"nullif({sql.credential('taxonomy_descriptions')}, ''))")})
_ENTRY = ("coalesce(list_filter(list_transform(string_split(taxonomy_descriptions, ';'), lambda e: trim(e)), "
          "lambda e: e <> '')[1], '')")
_ENTRY = f"case when trim(taxonomy_descriptions) = '(empty)' then '' else {_ENTRY} end"
_register("b12_parse_taxonomy", "p", "_ord", {
    "specialty": lambda: credentials.parse_taxonomy("taxonomy_descriptions")["specialty"],
    "subspecialty": lambda: credentials.parse_taxonomy("taxonomy_descriptions")["subspecialty"]}, {
    "specialty": f"trim(split_part({_ENTRY}, ',', 1))",
    "subspecialty": f"case when contains({_ENTRY}, ',') then trim(substr({_ENTRY}, strpos({_ENTRY}, ',') + 1)) else '' end"})


def _parse_full_name(spark, sf_dir):
    p = names.parse_full_name("full_name")
    return board(spark, sf_dir).select("_ord", p["last"].alias("l"), p["first"].alias("f"), p["middle"].alias("m"))


QUERIES["b13_parse_full_name"] = _parse_full_name
SQL["b13_parse_full_name"] = sql.with_inputs(
    "m",
    "select _ord, case when comma then trim(split_part(t, ',', 1)) else coalesce(w[-1], '') end as l, "
    "case when comma then coalesce(r[1], '') when len(w) >= 2 then w[1] else '' end as f, "
    "case when comma then array_to_string(r[2:], ' ') when len(w) > 2 then array_to_string(w[2:-2], ' ') else '' end as m "
    f"from (select *, {sql.word_list('t')} as w, "
    f"{sql.word_list('case when comma then substr(t, strpos(t, chr(44)) + 1) else chr(32) end')} as r "
    f"from (select _ord, t, contains(t, ',') as comma from (select _ord, {sql.strip_suffix(sql.strip('full_name'))} as t from m)))",
)
_COUNTY = sql.title(sql.sub(sql.sub(sql.strip("county1"), r"\s+", " "), r"(?i)\bSt\.", "St"))
_register("b14_normalize_county", "v", "rid", {"county": lambda: text.normalize_county("county1")}, {"county": _COUNTY})
_FIPS = sql.digits("primary_address_1")
_register("b15_fips5", "p", "_ord", {"f": lambda: text.fips5("primary_address_1")},
          {"f": f"case when length({_FIPS}) < 5 then lpad({_FIPS}, 5, '0') else {_FIPS} end"})
_register("b16_coalesce_blank", "v", "rid", {"c": lambda: text.coalesce_blank("county1", "county2")}, {
    "c": "coalesce(" + ", ".join(f"case when lower(trim({c})) not in ('', 'nan') then trim({c}) end"
                                 for c in ("county1", "county2")) + ", '')"})
_NONEMPTY = ("last_name", "npi", "email", "certification", "note", "health_system")
_register("b17_count_nonempty", "m", "_ord", {"n": lambda: text.count_nonempty(list(_NONEMPTY))}, {
    "n": "cast(" + " + ".join(f"case when trim({c}) in ('', 'nan', 'NaN') then 0 else 1 end" for c in _NONEMPTY) + " as integer)"})
_register("b18_valid_npi", "p", "_ord", {"npi": lambda: text.valid_npi("npi")},
          {"npi": "case when regexp_full_match(trim(npi), '[0-9]{10}') then trim(npi) else '' end"})
_NOT_ORG = "|".join(fv.NOT_A_LABEL)
_register("b19_address_tests", "p", "_ord", {
    "po_box": lambda: addresses.is_po_box("mailing_address_1"), "org": lambda: labels.is_org_name("primary_address_2")}, {
    "po_box": f"regexp_matches(mailing_address_1, '(?i){fv.PO_BOX}')",
    "org": "regexp_matches(trim(primary_address_2), '^[a-zA-Z]') and not "
           f"regexp_matches(primary_address_2, '(?i){fv.PO_BOX}') and not "
           f"regexp_matches(trim(primary_address_2), '(?i)^(?:{_NOT_ORG})')"})
_register("b20_label_tests", "m", "_ord", {
    "bad": lambda: labels.is_bad_label("health_system"), "bad_short": lambda: labels.is_bad_label("note", extended=False),
    "person": lambda: labels.is_individual_label("health_system")}, {
    "bad": sql.bad_label("health_system"), "bad_short": sql.bad_label("note", False),
    "person": sql.individual_label("health_system")})
_L, _FI = sql.norm_name("last_name"), sql.norm_name("first_name")
_register("b21_name_keys", "p", "_ord", {
    "init": lambda: names.initial("first_name"), "k": lambda: names.name_key("last_name", "first_name"),
    "k_mid": lambda: names.name_key_mid("last_name", "first_name", "middle_name"),
    "k_init": lambda: names.key_last_initial("last_name", "first_name"),
    "k_cred": lambda: names.key_last_initial_cred("last_name", "first_name", "credential"),
    "k_addr": lambda: names.name_addr_key("last_name", "first_name", "primary_address_1", "zip5")}, {
    "init": f"substr({_FI}, 1, 1)", "k": f"{_L} || '|' || {_FI}",
    "k_mid": f"{_L} || '|' || {_FI} || '|' || substr({sql.norm_name('middle_name')}, 1, 1)",
    "k_init": f"{_L} || '|' || substr({_FI}, 1, 1)",
    "k_cred": f"{_L} || '|' || substr({_FI}, 1, 1) || '||' || {sql.credential('credential')}",
    "k_addr": f"{_L} || '|' || {_FI} || '||' || {sql.norm_addr('primary_address_1', 'basic')} || '|' || {sql.zip5('zip5')}"})
_lists("b22_name_variants", "p", lambda: names.name_variants("last_name", "first_name"),
       sql.name_variants("p", "last_name", "first_name"))
_lists("b22_name_variants_cleaned", "m", lambda: names.name_variants("last_name", "first_name", cleaned=True),
       sql.name_variants("m", "last_name", "first_name", True))
_lists("b23_fullname_variants", "m", lambda: names.fullname_variants("full_name", 2), sql.fullname_variants("m", "full_name", 2))
_lists("b23_fullname_variants_three", "m", lambda: names.fullname_variants("full_name", 3),
       sql.fullname_variants("m", "full_name", 3))
_lists("b24_mixed_name_keys", "m", lambda: names.mixed_name_keys("last_name", "full_name", initials=True),
       sql.mixed_keys("m", "last_name", "full_name", True))
_lists("b24_mixed_name_keys_plain", "p", lambda: names.mixed_name_keys("last_name", "first_name"),
       sql.mixed_keys("p", "last_name", "first_name"))


def round2_keys_sql(source: str, a: str, b: str) -> str:
    plain = f"(select * exclude (l_, f_, f1_) from ({sql.name_variants(source, a, b, out='k1')}))"
    full = sql.fullname_variants(plain, b, 2, False, out="k2")
    full = f"(select * exclude (whole_, bare_, full_, base_, w_), {sql.word_list(sql.norm(b))}[-1] as surname_ from ({full}))"
    last = sql.name_variants(full, "surname_", a, out="k3")
    return (
        f"select * exclude (l_, f_, f1_, surname_, k1, k2, k3), case when contains({sql.norm(b)}, ' ') "
        f"then list_distinct(list_concat(k1, list_concat(k2, k3))) else k1 end as keys from ({last})"
    )


_lists("b25_round2_name_keys", "m", lambda: names.round2_name_keys("last_name", "full_name"),
       "select _ord, keys from (" + round2_keys_sql("(select _ord, last_name, full_name from m)", "last_name", "full_name") + ")")


def _pairs(spark, sf_dir):
    p = people(spark, sf_dir).where("npi <> ''").select("npi", F.col("primary_address_1").alias("a"), F.col("_ord").alias("left_ord"))
    m = board(spark, sf_dir).where("npi <> ''").select("npi", F.col("primary_address_1").alias("b"), F.col("_ord").alias("right_ord"))
    return p.join(m, "npi")


def _seq_ratio(spark, sf_dir):
    a, b = (addresses.norm_addr(c, "strict") for c in ("a", "b"))
    return _pairs(spark, sf_dir).select("left_ord", "right_ord", F.round(similarity.seq_ratio(a, b), 6).alias("ratio"))


def _lev_ratio(spark, sf_dir):
    ratio = similarity.seq_ratio(F.lower("a"), F.lower("b"), method="lev")
    return _pairs(spark, sf_dir).select("left_ord", "right_ord", F.round(ratio, 6).alias("ratio"))


QUERIES["b26_seq_ratio"] = _seq_ratio
QUERIES["b26_seq_ratio_lev"] = _lev_ratio
SQL["b26_seq_ratio_lev"] = sql.with_inputs(
    "p m",
    "select p._ord as left_ord, m._ord as right_ord, round(1 - levenshtein(lower(p.primary_address_1), "
    "lower(m.primary_address_1)) / greatest(length(p.primary_address_1), length(m.primary_address_1)), 6) as ratio "
    "from p join m on p.npi = m.npi where p.npi <> ''",
)
_ST, _Z = "upper(trim(primary_state))", sql.digits("primary_postal_code")
_register("b27_address_flags", "p", "_ord",
          {"flags": lambda: addresses.address_flags("primary_address_2", "primary_city", "primary_state", "primary_postal_code")}, {
    "flags": "array_to_string(list_filter([case when trim(primary_address_2) = '' then 'addr_blank' end, "
             f"case when trim(primary_city) = '' then 'city_blank' end, case when {_Z} = '' then 'zip_blank' "
             f"when length({_Z}) not in (5, 9) then 'zip_invalid' end, case when {_ST} <> '' and {_ST} not in ('MN', 'WI') "
             f"then 'state_not_mn(' || {_ST} || ')' when {_ST} = 'WI' and lower(primary_city) not like '%hudson%' "
             "then 'state_wi_not_hudson' end], lambda x: x is not null), ', ')"})
_register("b28_missing_flags", "m", "_ord",
          {"flags": lambda: addresses.missing_flags(["primary_address_2", "email"], "note", "zip5")}, {
    "flags": "array_to_string(list_filter([case when trim(primary_address_2) = '' and trim(email) = '' then 'missing_address' end, "
             "case when trim(note) = '' then 'missing_state' end, case when trim(zip5) = '' then 'missing_zip' end], "
             "lambda x: x is not null), '|')"})
_register("b29_source_label", "m", "_ord", {"label": lambda: names.source_label("note", "first_name")}, {
    "label": f"case when {sql.norm('note')} <> '' then {sql.norm('note')} when contains(trim(first_name), ' ') "
             "then 'mailingaddition' else 'firstmailing' end"})
_ADDRS = "primary_address_1 || '|' || primary_city || ' | ' || mailing_address_1 || '|' || mailing_city || '|' || zip5 || ' | |x'"


def _parse_addresses(spark, sf_dir):
    parsed = addresses.parse_addresses(F.expr(_ADDRS))
    rows = people(spark, sf_dir).select("_ord", F.posexplode(parsed).alias("at", "e"))
    return rows.select("_ord", "at", "e.addr", "e.city", "e.zip")


QUERIES["b30_parse_addresses"] = _parse_addresses
SQL["b30_parse_addresses"] = sql.with_inputs(
    "p",
    "select _ord, cast(row_number() over (partition by _ord order by i) - 1 as integer) as at, trim(split_part(e, '|', 1)) as addr, "
    "trim(split_part(e, '|', 2)) as city, trim(split_part(e, '|', 3)) as zip from "
    f"(select _ord, unnest(string_split({_ADDRS}, ' | ')) as e, generate_subscripts(string_split({_ADDRS}, ' | '), 1) as i from p) "
    "where trim(split_part(e, '|', 1)) <> ''",
)


def _checkboxes(spark, sf_dir):
    rows = survey_plain(spark, sf_dir)
    return rows.select(
        "rid", *[questions.checkbox_checked(c).alias(f"{c}_checked") for c in ("box1", "box2", "box3")],
        F.lit(questions.choice_label(SURVEY_HEADERS["box2"])).alias("choice"),
        F.lit(questions.parent_question(SURVEY_HEADERS["box2"])).alias("parent"),
        F.lit(questions.short_label(SURVEY_HEADERS["elig"], 20)).alias("short"),
    )


QUERIES["b31_checkbox_parts"] = _checkboxes
SQL["b31_checkbox_parts"] = sql.with_inputs(
    "v", "select rid, " + ", ".join(f"{sql.checked(c)} as {c}_checked" for c in ("box1", "box2", "box3"))
    + ", 'Tablet' as choice, 'Which tools do you use?' as parent, 'As part of your prac…' as short from v")
_QUESTION = ("case _ord % 6 when 0 then 'Intake Complete? .1' when 1 then 'Do you provide prenatal, delivery or postpartum care?' "
             "when 2 then 'What is your age' when 3 then 'Average week: how many days? .2' when 4 then credential else primary_city end")


def _question_class(spark, sf_dir):
    rows = people(spark, sf_dir).select("_ord", F.expr(_QUESTION).alias("q"))
    return rows.select("_ord", questions.question_class("q").alias("class"), questions.norm_question("q").alias("question"))


QUERIES["b32_question_class"] = _question_class
SQL["b32_question_class"] = sql.with_inputs(
    "p",
    "select _ord, case when regexp_matches(q, '(?i)complete\\?') then 'complete' when "
    + " or ".join(f"regexp_matches(lower(q), '{p}')" for p in fv.SCREENER_PATTERNS) + " then 'screener' when "
    + " or ".join(f"regexp_matches(lower(q), '{p}')" for p in fv.DEMOGRAPHIC_PATTERNS)
    + f" then 'demographic' else 'main' end as class, trim(regexp_replace(q, '\\s*\\.\\d+\\s*$', '')) as question from (select _ord, {_QUESTION} as q from p)",
)

PLACES = {
    "query_key": "lower(c_name)",
    "name": "case c_custkey % 5 when 0 then 'Lake Clinic ' || c_mktsegment when 1 then 'Sunny Apartments' "
    "when 2 then 'Acme ' || c_mktsegment when 3 then '' else 'Northern Hospital Hotel' end",
    "type_1": "case c_custkey % 3 when 0 then 'doctor' when 1 then 'store' else 'point_of_interest' end",
    "primary_type": "case c_custkey % 4 when 0 then 'pharmacy' else 'store' end",
    "formatted_address": "case c_custkey % 3 when 0 then '1 Main St, ' || c_mktsegment || ', MN 55000, USA' "
    "when 1 then 'Hudson, USA' else 'nowhere' end",
}


def places(spark, sf_dir):
    from rollbook.plans.inputs import table

    rows = table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in PLACES.items()])
    return rows.withColumn("types", F.array("type_1"))


def _place_label(spark, sf_dir):
    p = labels.place_label("name", "types", "primary_type", "formatted_address")
    return places(spark, sf_dir).select("query_key", p["label"].alias("label"), p["city"].alias("city"))


PLACES_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in PLACES.items()) + " from customer"
_TYPES = ", ".join(f"'{t}'" for t in fv.MEDICAL_TYPES)
PLACE_LABEL_SQL = (
    f"select query_key, case when regexp_matches(name, '(?i){fv.REAL_ESTATE_WORDS}') then 'REAL_ESTATE' "
    f"when regexp_matches(name, '(?i){fv.MEDICAL_WORDS}') or primary_type in ({_TYPES}) or type_1 in ({_TYPES}) then name "
    "else '' end as label, case when len(string_split(formatted_address, ',')) >= 3 "
    "then trim(string_split(formatted_address, ',')[-3]) when len(string_split(formatted_address, ',')) = 2 "
    f"then trim(string_split(formatted_address, ',')[1]) else '' end as city from ({PLACES_SQL})"
)
QUERIES["b33_place_label"] = _place_label
SQL["b33_place_label"] = PLACE_LABEL_SQL
