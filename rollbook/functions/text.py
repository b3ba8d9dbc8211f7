"""Text normalisation (native columns)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv


# everything Unicode calls white space, plus the four separators that count as white space in text files
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_column(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c if "`" in c else f"`{c}`")


def filled(c: Column | str) -> Column:
    """Null becomes ''."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly value once for an expression that reads it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(filled(c), F.lit(WHITE_SPACE))


def norm(c: Column | str) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return collapse(F.lower(filled(c)))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, none stays at the ends. Single blanks are left alone, not rewritten."""
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}|[^\S ]", " "))


def norm_name(c: Column | str) -> Column:
    """Lower case, suffix tokens removed anywhere, everything but a-z and 0-9 turned into single blanks.

    Real name tokens that look like a suffix ("do", "v") are removed as well.
    """
    noise = rf"(?U)\b(?:{'|'.join(fv.NAME_NOISE_TOKENS)})\b"
    bare = F.regexp_replace(F.lower(filled(c)), noise, "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(filled(c), r"[^0-9]+", "")


def zip5(c: Column | str) -> Column:
    """The first five digits."""
    return F.substring(digits(c), 1, 5)


def norm_phone(c: Column | str) -> Column:
    """NNN-NNN-NNNN when there are exactly ten digits, else the stripped original."""
    d = digits(c)
    return F.when(F.length(d) == 10, F.regexp_replace(d, "^(...)(...)(....)$", "$1-$2-$3")).otherwise(strip(c))


def title_case(c: Column | str) -> Column:
    """Upper case after any non-letter, lower case elsewhere ("o'brien-smith" gives "O'Brien-Smith")."""
    s = strip(c)
    pieces = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
    return F.when(s.rlike(r"[^\p{L} ]"), cased).otherwise(F.initcap(s))


def fips5(c: Column | str) -> Column:
    """Digits, left-padded with zeros to five; longer codes stay whole."""
    d = digits(c)
    return F.when(as_column(c).isNull(), "").when(F.length(d) < 5, F.lpad(d, 5, "0")).otherwise(d)


def normalize_county(c: Column | str) -> Column:
    s = collapse(filled(c))
    return title_case(F.regexp_replace(s, r"(?iU)\bSt\.", "St"))


def present(c: Column | str) -> Column:
    """True unless null, blank or the text "nan"."""
    return ~filled(c).rlike(r"(?iU)^\s*(?:nan\s*)?$")


def known(c: Column | str) -> Column:
    """The stripped text; "nan" counts as blank."""
    return F.regexp_replace(filled(c), r"(?iU)^\s*nan\s*$|^\s+|\s+$", "")


def coalesce_blank(*cols: Column | str) -> Column:
    """The first column that is present, stripped; '' if there is none."""
    return F.coalesce(*[F.when(present(c), strip(c)) for c in cols], F.lit(""))


def count_nonempty(cols: list[Column | str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.when(filled(c).rlike(r"(?U)^\s*(?:(?:nan|NaN)\s*)?$"), 0).otherwise(1)
    return total


def valid_npi(c: Column | str) -> Column:
    """The identifier when it is exactly ten digits, else ''."""
    return F.regexp_extract(filled(c), r"(?U)^\s*([0-9]{10})\s*$", 1)


def words_of(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(collapse(c), " "), "")


def first_word(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def abbreviate(c: Column, words: Mapping[str, str]) -> Column:
    """Replace whole words by their abbreviations in one pass.

    Every abbreviation is made of letters of its word in order, so the pattern captures just those letters
    ("(s)ui(te)") and the replacement puts the captures together. One regex pass serves the whole table.
    """
    groups = 0
    branches = []
    for word, short in words.items():
        branch, at, open_ = "", 0, False
        for letter in word:
            keep = at < len(short) and letter == short[at]
            if keep != open_:
                branch += "(" if keep else ")"
                groups += keep
                open_ = keep
            branch += letter
            at += keep
        if at != len(short):
            raise ValueError(f"{short!r} is not made of letters of {word!r} in order")
        branches.append(branch + (")" if open_ else ""))
    replacement = "".join(f"${i}" for i in range(1, groups + 1))
    return F.regexp_replace(c, rf"(?U)\b(?:{'|'.join(branches)})\b", replacement)
