import pytest
from pyspark.sql import functions as F

from rollbook.functions import addresses, credentials, labels, names, questions, similarity, text


def values(spark, expr, *inputs):
    """Apply a one- or two-column expression to rows and return the results in order."""
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(inputs)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    return [r[0] for r in df.orderBy("i").select(expr(*[F.col(f"c{j}") for j in range(width)])).collect()]


def test_norm(spark):
    got = values(spark, text.norm, "  Mary\t ANN ", None, "", "ÉCLAIR", "a\xa0\xa0b", "a\tb")
    assert got == ["mary ann", "", "", "éclair", "a b", "a b"]


def test_norm_name_drops_suffix_tokens_anywhere(spark):
    got = values(spark, text.norm_name, "Smith, Jr.", "O'Brien-Smith MD", "do Santos", "Ivy", None)
    assert got == ["smith", "o brien smith", "santos", "ivy", ""]


def test_zip_phone_fips(spark):
    assert values(spark, text.zip5, "55401-1234", "5540", None) == ["55401", "5540", ""]
    got = values(spark, text.norm_phone, "(612) 555-0100", " 555-0100 ", None, "1 612 555 0100")
    assert got == ["612-555-0100", "555-0100", "", "1 612 555 0100"]
    assert values(spark, text.fips5, "1001", "27-053", "1234567", None) == ["01001", "27053", "1234567", ""]


@pytest.mark.parametrize(
    "raw", ["o'brien-smith", "JOHN  SMITH", "mary2ann x", "élodie  d'arc", "  padded ", "a.b c", "", "mcDONALD's"]
)
def test_title_case_is_pythons(spark, raw):
    assert values(spark, text.title_case, raw) == [raw.strip().title()]


def test_strip_is_pythons(spark):
    raw = ["\x1c a \x85", " b　", " c\n\r\t", "​d"]
    assert values(spark, text.strip, *raw) == [r.strip() for r in raw]


def test_suffixes(spark):
    assert values(spark, names.clean_name, "Smith, Jr.", "Lee M.D.", "Doe MD", "Nguyen PhD.", "sr") == [
        "smith", "lee md", "doe", "nguyen", ""]
    assert values(spark, lambda c: names.clean_name(c, long=True), "Doe CRNA", "Doe FNP") == ["doe", "doe"]
    assert values(spark, names.clean_name, "Doe CRNA") == ["doe crna"]


def test_norm_addr_profiles(spark):
    raw = "1026 North Main Street, Suite #5"
    got = {p: values(spark, lambda c, p=p: addresses.norm_addr(c, p), raw)[0] for p in addresses.PROFILES}
    assert got == {
        "basic": "1026 n main st ste 5",
        "multi": "1026 n main st ste 5",
        "round2": "1026 n main st ste ste 5",
        "strict": "1026 main st ste ste 5 n",
    }


def test_norm_addr_strict_moves_the_direction(spark):
    got = values(spark, lambda c: addresses.norm_addr(c, "strict"), "1026 W 7th St", "1804 SW Trott Ave", "12 First Ave. W", "7 Ne")
    assert got == ["1026 7th st w", "1804 trott ave sw", "12 1st ave w", "7 ne"]


def test_norm_addr_round2_units(spark):
    got = values(spark, lambda c: addresses.norm_addr(c, "round2"), "5 Oak Parkway No. 100", "5 Oak Pkwy #100", "5 Northwest Expressway floor 2")
    assert got == ["5 oak pkwy ste 100", "5 oak pkwy ste 100", "5 nw expy fl 2"]


def test_abbreviate_is_one_pass_over_whole_words(spark):
    got = values(spark, lambda c: text.abbreviate(c, {"suite": "ste", "street": "st", "circle": "cir"}), "suite street circle streets suiteX")
    assert got == ["ste st cir streets suiteX"]
    with pytest.raises(ValueError):
        text.abbreviate(F.lit("x"), {"first": "1st"})


def test_norm_city(spark):
    assert values(spark, addresses.norm_city, "Saint Paul", "Fort  Snelling", "St. Paul") == ["st paul", "ft snelling", "st. paul"]
    assert values(spark, lambda c: addresses.norm_city(c, "strict"), "St. Paul", "Mount Iron") == ["st paul", "mt iron"]


def test_base_addr_key(spark):
    got = values(spark, addresses.base_addr_key, ("123 Main St, Ste 100", "Edina"), ("123 Main St Suite 200", " edina"), ("nan", "nan"), (None, None))
    assert got == ["123 main st|edina", "123 main st|edina", "|", "|"]


@pytest.mark.parametrize(
    "raw, category",
    [("MD", "physician"), ("Medical Doctor", "physician"), ("D.O.", "physician"), ("PA-C", "pa"),
     ("Physician Assistant", "pa"), ("CNM", "cnm"), ("NM", "cnm"), ("CNP", "np"), ("FNP-BC", "np"), ("APRN", "np"),
     ("CNS", "cns"), ("CRNA", "crna"), ("RN", "rn"), ("", ""), (None, ""), ("Podiatry", "")],
)
def test_norm_credential(spark, raw, category):
    assert values(spark, credentials.norm_credential, raw) == [category]


def test_display_title_takes_the_first_known(spark):
    got = values(spark, lambda a, b: credentials.display_title([a, b]), ("", "RN"), ("MD", "RN"), ("x", "y"))
    assert got == ["RN", "Dr", ""]


def test_parse_taxonomy(spark):
    got = values(spark, credentials.parse_taxonomy, "Family Medicine; Family Medicine",
                 "Internal Medicine, Cardiovascular Disease; Internal Medicine",
                 "Obstetrics & Gynecology, Gynecologic Oncology; x", "(empty)", None, " ; ;B, c, d ;", ", x")
    assert [tuple(g) for g in got] == [
        ("Family Medicine", ""), ("Internal Medicine", "Cardiovascular Disease"),
        ("Obstetrics & Gynecology", "Gynecologic Oncology"), ("", ""), ("", ""), ("B", "c, d"), ("", "x")]


def test_parse_full_name(spark):
    got = values(spark, names.parse_full_name, "Smith, John A. B.", "John A. B. Smith MD", "John Smith", "Smith", "", "Smith,", None)
    assert [tuple(g) for g in got] == [
        ("Smith", "John", "A. B."), ("Smith", "John", "A. B."), ("Smith", "John", ""), ("Smith", "", ""), ("", "", ""),
        ("Smith", "", ""), ("", "", "")]


def test_name_variants(spark):
    got = values(spark, names.name_variants, ("Smith Jr.", "Mary Ann"), ("", "Mary"), ("Smith", ""), (None, None), ("de la Cruz", "Ana"))
    assert set(got[0]) == {"mary ann smith", "smith mary ann", "smith, mary ann", "mary smith", "smith mary", "smith, mary"}
    assert [set(g) for g in got[1:]] == [{"mary"}, {"smith"}, set(), {"ana de la cruz", "de la cruz ana", "de la cruz, ana"}]


def test_fullname_variants(spark):
    two = values(spark, lambda c: names.fullname_variants(c, 2), "John Smith MD", "Smith", "")
    assert [set(g) for g in two] == [{"john smith md", "john smith", "smith john", "smith, john"}, {"smith"}, set()]
    three = values(spark, lambda c: names.fullname_variants(c, 3), "John Smith", "John A Smith")
    assert [set(g) for g in three] == [{"john smith"}, {"john a smith", "john smith", "smith john", "smith, john"}]


def test_mixed_name_keys_are_ranked(spark):
    got = values(spark, lambda a, b: names.mixed_name_keys(a, b, initials=True), ("Smith", "Mary"), ("Kaeley", "Kaeley Whiting Allen"), ("", "x"), ("Doe", "A B"))
    assert got[0] == ["smith|mary", "smith|~m"]
    assert got[1] == ["allen|kaeley", "whiting allen|kaeley", "allen|~k", "whiting allen|~k"]
    assert got[2] == []
    assert got[3] == ["b|a", "b|~a"]


def test_round2_name_keys_try_every_reading(spark):
    plain, mixed = values(spark, names.round2_name_keys, ("Smith", "John"), ("John", "John Smith"))
    assert set(plain) == {"john smith", "smith john", "smith, john"}
    assert {"john smith", "smith, john", "john smith john"} <= set(mixed)


def test_labels(spark):
    assert values(spark, labels.is_org_name, "Lake Clinic", "PO Box 5", "Suite 100", "123 Main", "", "n/a", " c/o Bob") == [
        True, False, False, False, False, False, False]
    assert values(spark, labels.is_bad_label, "mr# 5", "Acme mr# 5", "Clinic, Department of X", "*** x", "At Home", "home", "homestead", "nan") == [
        True, False, False, True, True, True, False, False]
    assert values(spark, labels.is_individual_label, "Dr. Roe", "Jane Roe, MD", "Lakes PA", "Roe - DO", "Clinic MD") == [True, True, False, True, True]


def test_place_label(spark):
    types = F.array(F.lit("store"))
    got = values(spark, lambda n, a: labels.place_label(n, types, F.lit(""), a),
                 ("Lake Clinic", "1 Main, Edina, MN 55, USA"), ("Sunny Hotel Clinic", "Edina, USA"), ("Acme", ""))
    assert [tuple(g) for g in got] == [("Lake Clinic", "Edina"), ("REAL_ESTATE", "Edina"), ("", "")]


def test_seq_ratio_is_difflibs(spark):
    from difflib import SequenceMatcher

    pairs = [("12 oak st", "12 oak ave"), ("", ""), ("abcd", "bcde"), ("x", "")]
    assert values(spark, similarity.seq_ratio, *pairs) == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_address_flags(spark):
    df = spark.createDataFrame(
        [(0, "1 A", "Edina", "MN", "55401"), (1, "", "", "ia", "554"), (2, "1 A", "Hudson", "WI", "55401-1234"),
         (3, "1 A", "Eau Claire", " wi", ""), (4, "1 A", "Edina", "", "55401")], "i int, a string, c string, s string, z string")
    got = [r[0] for r in df.orderBy("i").select(addresses.address_flags("a", "c", "s", "z")).collect()]
    assert got == ["", "addr_blank, city_blank, zip_invalid, state_not_mn(IA)", "", "zip_blank, state_wi_not_hudson", ""]


def test_small_helpers(spark):
    assert values(spark, text.coalesce_blank, ("nan", " x "), ("", None), (" NaN ", "y")) == ["x", "", "y"]
    assert values(spark, lambda a, b: text.count_nonempty([a, b]), ("nan", "NAN"), ("", "x"), (None, "NaN")) == [1, 1, 0]
    assert values(spark, text.valid_npi, " 1234567890 ", "123456789", "12345678901", None) == ["1234567890", "", "", ""]
    assert values(spark, names.source_label, ("Gold ", "x"), ("", "a b"), (None, " a ")) == ["gold", "mailingaddition", "firstmailing"]
    got = values(spark, addresses.parse_addresses, "1 A|Edina|55 | 2 B | |x|y", "")
    assert [[tuple(e) for e in g] for g in got] == [[("1 A", "Edina", "55"), ("2 B", "", "")], []]


def test_survey_headers():
    header = "Which tools?  (select all that apply) (choice=Paper (long) form) "
    assert questions.choice_label(header) == "Paper (long) form"
    assert questions.parent_question(header) == "Which tools?"
    assert questions.short_label("a  b" * 50, 5) == "a ba …"
    assert questions.scale_of("CLINICIANS SHOULD SCREEN all")[0] == "Strongly agree"
    assert questions.scale_of("x") is None


def test_question_class(spark):
    got = values(spark, questions.question_class, "Intake Complete?", "Do you provide prenatal, delivery or postpartum care", "What is your age?", "Other")
    assert got == ["complete", "screener", "demographic", "main"]
    assert values(spark, questions.norm_question, "Age? .1", "v1.2 of x") == ["Age?", "v1.2 of x"]
