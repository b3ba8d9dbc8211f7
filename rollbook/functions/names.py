"""Names: suffixes, parsing, and the keys under which two records can meet (native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.addresses import norm_addr
from rollbook.functions.credentials import norm_credential
from rollbook.functions.text import filled, first_word, let, norm, norm_name, strip, words_of, zip5

NO_KEYS = "array<string>"


def strip_suffix(c: Column | str, long: bool = False) -> Column:
    """Remove one trailing credential or generation suffix. `long` adds fnp, crna and crnp."""
    suffixes = fv.TRAILING_SUFFIXES_LONG if long else fv.TRAILING_SUFFIXES
    return strip(F.regexp_replace(filled(c), rf"(?iU)\b(?:{'|'.join(suffixes)})\.?\s*$", ""))


def clean_name(c: Column | str, long: bool = False) -> Column:
    """norm, one suffix off, commas and periods out."""
    return F.trim(F.regexp_replace(strip_suffix(norm(c), long), "[,.]", ""))


def parse_full_name(c: Column | str) -> Column:
    """'Last, First Middle' or 'First Middle Last' to a struct (last, first, middle), suffix stripped."""

    def tail(words: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, 2, F.greatest(length, F.lit(0))), " ")

    def with_comma(text: Column) -> Column:
        return let(
            words_of(F.substr(text, F.instr(text, ",") + 1)),
            lambda w: F.struct(
                strip(F.substring_index(text, ",", 1)).alias("last"),
                F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first"),
                tail(w, F.size(w) - 1).alias("middle"),
            ),
        )

    def plain(text: Column) -> Column:
        return let(
            words_of(text),
            lambda w: F.struct(
                F.coalesce(F.get(w, F.size(w) - 1), F.lit("")).alias("last"),
                F.when(F.size(w) >= 2, F.get(w, F.lit(0))).otherwise("").alias("first"),
                tail(w, F.size(w) - 2).alias("middle"),
            ),
        )

    return let(strip_suffix(strip(c)), lambda t: F.when(F.instr(t, ",") > 0, with_comma(t)).otherwise(plain(t)))


def initial(c: Column | str) -> Column:
    return F.substring(norm_name(c), 1, 1)


def name_key(last: Column | str, first: Column | str) -> Column:
    return F.concat_ws("|", norm_name(last), norm_name(first))


def name_key_mid(last: Column | str, first: Column | str, middle: Column | str) -> Column:
    return F.concat_ws("|", norm_name(last), norm_name(first), initial(middle))


def key_last_initial(last: Column | str, first: Column | str) -> Column:
    return F.concat_ws("|", norm_name(last), initial(first))


def key_last_initial_cred(last: Column | str, first: Column | str, credential: Column | str) -> Column:
    return F.concat_ws("||", key_last_initial(last, first), norm_credential(credential))


def name_addr_key(last: Column | str, first: Column | str, addr: Column | str, zip_: Column | str) -> Column:
    return F.concat_ws("||", name_key(last, first), F.concat_ws("|", norm_addr(addr, "basic"), zip5(zip_)))


def first_token_key(last: Column | str, first: Column | str, long: bool = True) -> Column:
    """Cleaned last name and the first token of the cleaned first name."""
    return F.concat_ws("|", clean_name(last, long), first_word(clean_name(first, long)))


def _three_ways(a: Column, b: Column) -> list[Column]:
    return [F.concat_ws(" ", a, b), F.concat_ws(" ", b, a), F.concat_ws(", ", b, a)]


def name_variants(last: Column | str, first: Column | str, cleaned: bool = False) -> Column:
    """'f l', 'l f' and 'l, f' for the whole first name and for its first token; a single side stands alone.

    `cleaned` also drops commas and periods from both sides first.
    """
    prepare = clean_name if cleaned else (lambda c: strip_suffix(norm(c)))
    return let(F.struct(prepare(last).alias("l"), prepare(first).alias("f")), lambda x: _variants(x["l"], x["f"]))


def _variants(l: Column, f: Column) -> Column:
    f1 = first_word(f)
    return (
        F.when((l == "") & (f == ""), F.array().cast(NO_KEYS))
        .when(f == "", F.array(l))
        .when(l == "", F.array_distinct(F.array(f, f1)))
        .when(f == f1, F.array(*_three_ways(f, l)))
        .otherwise(F.array(*_three_ways(f, l), *_three_ways(f1, l)))
    )


def fullname_variants(c: Column | str, min_words: int = 2, keep_full: bool = True, cleaned: bool = False) -> Column:
    """The full text, the text without suffix, and first+last in three arrangements.

    `keep_full=False` starts from the text without suffix; `cleaned` passes every variant through `clean_name`.
    """

    def variants(full: Column, bare: Column) -> Column:
        base = F.when(bare == "", full).otherwise(bare)

        def arranged(w: Column) -> Column:
            ends = _three_ways(F.get(w, F.lit(0)), F.get(w, F.size(w) - 1))
            return F.when(F.size(w) >= min_words, F.array(full, base, *ends)).otherwise(F.array(full, base))

        return F.when(full == "", F.array().cast(NO_KEYS)).otherwise(let(words_of(base), arranged))

    def from_full(full: Column) -> Column:
        if keep_full:
            return let(strip_suffix(full), lambda bare: variants(full, bare))
        return let(strip_suffix(full), lambda bare: variants(bare, bare))

    keys = let(norm(c), from_full)
    if cleaned:
        keys = F.transform(keys, lambda k: clean_name(k))
    return F.array_distinct(keys)


def _last_first_keys(last: Column, first: Column, initials: bool) -> list[Column]:
    """Ranked candidates: whole first name, first token, and optionally the marked initial. Null when not usable."""
    token = first_word(first)
    usable = (last != "") & (first != "")
    keys = [F.when(usable, F.concat_ws("|", last, first)), F.when(usable, F.concat_ws("|", last, token))]
    if initials:
        keys.append(F.when(usable, F.concat(last, F.lit("|~"), F.substring(token, 1, 1))))
    return keys


def last_first_keys(last: Column | str, first: Column | str, initials: bool = True) -> Column:
    """Ranked keys of a last and a first name: whole first name, first token, marked initial."""
    parts = F.struct(clean_name(last, long=True).alias("l"), clean_name(first, long=True).alias("f"))
    keys = let(parts, lambda x: F.array(*_last_first_keys(x["l"], x["f"], initials)))
    return F.array_distinct(F.array_compact(keys))


def mixed_name_keys(a: Column | str, b: Column | str, initials: bool = False) -> Column:
    """Keys for columns that hold either (last, first) or (first, full name); exact keys come before initials.

    When `b` contains a blank it is the full name: the last word, and for three or more words the last two words,
    are tried as the surname. The position in the array is the rank of the key.
    """

    def from_words(w: Column) -> Column:
        n = F.size(w)
        compound = F.when(n >= 3, F.concat_ws(" ", F.get(w, n - 2), F.get(w, n - 1))).otherwise("")
        parts = F.struct(
            clean_name(F.get(w, F.lit(0)), long=True).alias("first"),
            clean_name(F.get(w, n - 1), long=True).alias("surname"),
            clean_name(compound, long=True).alias("compound"),
        )

        def keys(x: Column) -> Column:
            one = _last_first_keys(x["surname"], x["first"], initials)
            two = _last_first_keys(x["compound"], x["first"], initials)
            return F.array(*one[:2], *two[:2], *one[2:], *two[2:])

        return let(parts, keys)

    def from_whole(whole: Column) -> Column:
        plain = let(clean_name(a, long=True), lambda last: F.array(*_last_first_keys(last, whole, initials)))
        return F.when(F.instr(whole, " ") > 0, let(words_of(whole), from_words)).otherwise(plain)

    return F.array_distinct(F.array_compact(let(clean_name(b, long=True), from_whole)))


def slash_name_keys(last: Column | str, first: Column | str) -> Column:
    """'l|f' and 'f|l' for the cleaned first name and its first token; a single side stands alone."""

    def keys(l: Column, f: Column) -> Column:
        f1 = first_word(f)
        both = [F.concat_ws("|", l, f), F.concat_ws("|", f, l), F.concat_ws("|", l, f1), F.concat_ws("|", f1, l)]
        return (
            F.when((l == "") & (f == ""), F.array().cast(NO_KEYS))
            .when(f == "", F.array(l))
            .when(l == "", F.array(f, f1))
            .otherwise(F.array(*both))
        )

    names = F.struct(clean_name(last).alias("l"), clean_name(first).alias("f"))
    return F.array_distinct(let(names, lambda x: keys(x["l"], x["f"])))


def slash_fullname_keys(c: Column | str) -> Column:
    """The same keys from a full name: first and last word, or the single word."""

    def keys(w: Column) -> Column:
        head, tail = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
        return (
            F.when(F.size(w) == 0, F.array().cast(NO_KEYS))
            .when(F.size(w) == 1, F.array(head))
            .otherwise(F.array(F.concat_ws("|", tail, head), F.concat_ws("|", head, tail)))
        )

    return F.array_distinct(let(words_of(clean_name(c)), keys))


def round2_name_keys(a: Column | str, b: Column | str) -> Column:
    """Union of the keys of (a=last, b=first), of b as a full name, and of (last word of b, a)."""

    def keys(a_: Column, b_: Column) -> Column:
        surname = F.substring_index(b_, " ", -1)
        mixed = F.array_union(
            F.array_union(name_variants(a_, b_), fullname_variants(b_, 2, keep_full=False)), name_variants(surname, a_)
        )
        return F.when(F.instr(b_, " ") > 0, mixed).otherwise(name_variants(a_, b_))

    return let(F.struct(norm(a).alias("a"), norm(b).alias("b")), lambda x: keys(x["a"], x["b"]))


def source_label(existing: Column | str, b: Column | str) -> Column:
    """Existing labels are normalised; a blank one becomes mailingaddition when `b` holds a blank, else firstmailing."""
    blank = F.when(F.instr(strip(b), " ") > 0, "mailingaddition").otherwise("firstmailing")
    return F.coalesce(F.nullif(norm(existing), F.lit("")), blank)
