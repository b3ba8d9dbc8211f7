"""Address normalisation, address keys and address flags (native columns)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.text import abbreviate, digits, filled, known, let, norm, strip, zip5

PROFILES = ("basic", "multi", "round2", "strict")


def _squeeze(c: Column, marks: str) -> Column:
    """Turn runs of white space and the given marks into one blank."""
    return F.trim(F.regexp_replace(c, rf"(?U)[\s{marks}]+", " "))


def _ordinals(c: Column) -> Column:
    replaced = c
    for word, short in fv.ORDINAL_WORDS.items():
        replaced = F.regexp_replace(replaced, rf"(?U)\b{word}\b", short)
    return F.when(c.rlike(rf"(?U)\b(?:{'|'.join(fv.ORDINAL_WORDS)})\b"), replaced).otherwise(c)


def norm_addr(c: Column | str, profile: str = "basic") -> Column:
    """Street abbreviation for comparison.

    basic   suite, street words and directions; all punctuation out
    multi   street words, suite and cardinal directions; , # . out
    round2  more street words, floors and buildings, "#100" and "No. 100" read as "ste 100", all directions; , . out
    strict  ordinal words, "#100", cardinal directions; punctuation out; a direction after the house number moves last
    """
    if profile == "basic":
        words = fv.SUITE_WORDS | fv.STREET_WORDS | fv.INTERCARDINAL_WORDS | fv.CARDINAL_WORDS
        s = abbreviate(F.lower(filled(c)), words)
        return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    if profile == "multi":
        return _squeeze(abbreviate(norm(c), fv.STREET_WORDS | fv.SUITE_WORDS | fv.CARDINAL_WORDS), "#,.")
    if profile == "round2":
        places = fv.STREET_WORDS | fv.PARKWAY_WORDS | fv.EXPRESSWAY_WORDS | fv.SUITE_WORDS | fv.BUILDING_WORDS
        s = abbreviate(norm(c), places)
        s = F.regexp_replace(s, r"(?U)(?:\bno\.?\s+|#\s*)(?=\d)", "ste ")
        return _squeeze(abbreviate(s, fv.INTERCARDINAL_WORDS | fv.CARDINAL_WORDS), ",.")
    if profile == "strict":
        places = fv.STREET_WORDS | fv.PARKWAY_WORDS | fv.SUITE_WORDS | fv.BUILDING_WORDS
        s = abbreviate(_ordinals(norm(c)), places)
        s = F.regexp_replace(s, r"(?U)#\s*(?=\d)", "ste ")
        s = _squeeze(abbreviate(s, fv.CARDINAL_WORDS), r",.#\-")
        return F.regexp_replace(s, "(?U)" + fv.PRE_DIRECTION, "$1 $3 $2")
    raise ValueError(f"unknown profile {profile!r}; one of {PROFILES}")


def norm_city(c: Column | str, profile: str = "round2") -> Column:
    """Saint, fort and mount abbreviated; `strict` drops periods first."""
    s = norm(c)
    if profile == "strict":
        s = F.regexp_replace(s, r"\.", "")
    return _squeeze(abbreviate(s, fv.CITY_WORDS), "")


def addr_key(addr: Column | str, city: Column | str, zip_: Column | str) -> Column:
    """norm(addr)|norm(city)|zip5."""
    return F.concat_ws("|", norm(addr), norm(city), zip5(zip_))


def strict_addr_key(addr: Column | str, city: Column | str, zip_: Column | str) -> Column:
    return F.concat_ws("|", norm_addr(addr, "strict"), norm_city(city, "strict"), zip5(zip_))


def base_addr_key(addr: Column | str, city: Column | str) -> Column:
    """Address without suite, floor or unit tail, joined with the city; '|' when both are blank."""
    bare = strip(F.regexp_replace(known(addr), "(?iU)" + fv.UNIT_TAIL, ""))
    return F.concat_ws("|", norm(F.regexp_replace(bare, ",+$", "")), norm(known(city)))


def is_po_box(c: Column | str) -> Column:
    return filled(c).rlike("(?iU)" + fv.PO_BOX)


def address_flags(
    addr: Column | str,
    city: Column | str,
    state: Column | str,
    zip_: Column | str,
    allowed: Sequence[str] = ("MN", "WI"),
    exceptions: Mapping[str, str] | None = None,
) -> Column:
    """Comma-joined problems of an address.

    A state outside `allowed` is flagged with its value; a state in `exceptions` is fine only for the named city.
    """
    exceptions = {"WI": "hudson"} if exceptions is None else exceptions
    home = allowed[0].lower()
    st, d = F.upper(strip(state)), digits(zip_)
    return let(
        F.struct(st.alias("st"), d.alias("d")),
        lambda x: _flags(addr, city, x["st"], x["d"], allowed, exceptions, home),
    )


def _flags(addr, city, st: Column, d: Column, allowed, exceptions, home: str) -> Column:
    odd_city = F.lit(None).cast("string")
    for code, place in exceptions.items():
        flag = F.lit(f"state_{code.lower()}_not_{place}")
        odd_city = F.when((st == code) & ~F.lower(filled(city)).contains(place), flag).otherwise(odd_city)
    return F.concat_ws(
        ", ",
        F.when(strip(addr) == "", "addr_blank"),
        F.when(strip(city) == "", "city_blank"),
        F.when(d == "", "zip_blank").when(~F.length(d).isin(5, 9), "zip_invalid"),
        F.when(
            (st != "") & ~st.isin(*allowed), F.concat(F.lit(f"state_not_{home}("), st, F.lit(")"))
        ).otherwise(odd_city),
    )


def missing_flags(addr_cols: Sequence[Column | str], state: Column | str | None, zip_: Column | str | None) -> Column:
    """Pipe-joined: missing_address only when every address column is blank, missing_state, missing_zip."""
    blank = F.lit(True)
    for c in addr_cols:
        blank = blank & (norm(c) == "")
    parts = [F.when(blank, "missing_address")]
    if state is not None:
        parts.append(F.when(norm(state) == "", "missing_state"))
    if zip_ is not None:
        parts.append(F.when(norm(zip_) == "", "missing_zip"))
    return F.concat_ws("|", *parts)


def parse_addresses(c: Column | str) -> Column:
    """'a|c|z | a|c|z' to an array of (addr, city, zip); entries without an address are dropped."""
    entries = F.filter(F.split(filled(c), r" \| "), lambda e: strip(F.split(e, r"\|")[0]) != "")

    def part(e: Column, i: int) -> Column:
        return strip(F.get(F.split(e, r"\|"), F.lit(i)))

    return F.transform(
        entries, lambda e: F.struct(part(e, 0).alias("addr"), part(e, 1).alias("city"), part(e, 2).alias("zip"))
    )
