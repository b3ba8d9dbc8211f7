"""Pieces of DuckDB SQL from which the expected results are built."""

from __future__ import annotations

from collections.abc import Mapping

from rollbook import fixed_values as fv
from rollbook.plans.inputs import BOARD_SQL, COURSES_SQL, MESSAGES_SQL, PEOPLE_SQL, SURVEY_SQL


INPUTS = {"p": PEOPLE_SQL, "m": BOARD_SQL, "v": SURVEY_SQL, "docs": COURSES_SQL, "msgs": MESSAGES_SQL}


def with_inputs(names: str, query: str, **ctes: str) -> str:
    """A query over the named inputs (p people, m board, v survey, docs, msgs) and further CTEs in their order."""
    parts = [(n, INPUTS[n]) for n in names.split()] + list(ctes.items())
    return f"with {', '.join(f'{n} as ({q})' for n, q in parts)} {query}"


def filled(x: str) -> str:
    return f"coalesce({x}, '')"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x: str) -> str:
    return sub(filled(x), r"^\s+|\s+$", "")


def norm(x: str) -> str:
    return f"trim({sub(f'lower({filled(x)})', chr(92) + 's+', ' ')})"


def norm_name(x: str) -> str:
    bare = sub(f"lower({filled(x)})", rf"\b({'|'.join(fv.NAME_NOISE_TOKENS)})\b", "")
    return f"trim({sub(sub(bare, '[^a-z0-9 ]', ' '), ' +', ' ')})"


def digits(x: str) -> str:
    return sub(filled(x), "[^0-9]", "")


def zip5(x: str) -> str:
    return f"substr({digits(x)}, 1, 5)"


def title(x: str) -> str:
    parts = f"regexp_extract_all(lower({strip(x)}), '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1:1]) || w[2:]), '')"


def strip_suffix(x: str, long: bool = False) -> str:
    suffixes = fv.TRAILING_SUFFIXES_LONG if long else fv.TRAILING_SUFFIXES
    return strip(f"regexp_replace({filled(x)}, '(?i)\\b({'|'.join(suffixes)})\\.?\\s*$', '')")


def clean_name(x: str, long: bool = False) -> str:
    return f"trim({sub(strip_suffix(norm(x), long), '[,.]', '')})"


def words(x: str, table: Mapping[str, str]) -> str:
    for word, short in table.items():
        x = sub(x, rf"\b{word}\b", short)
    return x


def squeeze(x: str) -> str:
    return f"trim({sub(x, chr(92) + 's+', ' ')})"


def norm_addr(x: str, profile: str) -> str:
    if profile == "basic":
        table = fv.SUITE_WORDS | fv.STREET_WORDS | fv.INTERCARDINAL_WORDS | fv.CARDINAL_WORDS
        return squeeze(sub(words(f"lower({filled(x)})", table), "[^a-z0-9 ]", " "))
    if profile == "multi":
        table = fv.STREET_WORDS | fv.SUITE_WORDS | fv.CARDINAL_WORDS
        return squeeze(sub(words(norm(x), table), "[,#.]", " "))
    if profile == "round2":
        table = fv.STREET_WORDS | fv.PARKWAY_WORDS | fv.EXPRESSWAY_WORDS | fv.SUITE_WORDS | fv.BUILDING_WORDS
        s = sub(words(norm(x), table), r"\bno\.?\s+([0-9])", r"ste \1")
        s = sub(s, r"#\s*([0-9])", r"ste \1")
        return squeeze(sub(words(s, fv.INTERCARDINAL_WORDS | fv.CARDINAL_WORDS), "[,.]", " "))
    table = fv.STREET_WORDS | fv.PARKWAY_WORDS | fv.SUITE_WORDS | fv.BUILDING_WORDS
    s = sub(words(words(norm(x), fv.ORDINAL_WORDS), table), r"#\s*([0-9])", r"ste \1")
    s = squeeze(sub(sub(words(s, fv.CARDINAL_WORDS), "[,.]", " "), "[.,#-]", " "))
    return f"regexp_replace({s}, '{fv.PRE_DIRECTION}', '\\1 \\3 \\2')"


def norm_city(x: str, profile: str) -> str:
    s = norm(x)
    if profile == "strict":
        s = sub(s, r"\.", "")
    return squeeze(words(s, fv.CITY_WORDS))


def strict_key(addr: str, city: str, zip_: str) -> str:
    return f"{norm_addr(addr, 'strict')} || '|' || {norm_city(city, 'strict')} || '|' || {zip5(zip_)}"


def known(x: str) -> str:
    return f"case when lower({strip(x)}) = 'nan' then '' else {strip(x)} end"


def base_key(addr: str, city: str) -> str:
    bare = strip(f"regexp_replace({known(addr)}, '(?i){fv.UNIT_TAIL}', '', 'g')")
    return f"{norm(f'regexp_replace({bare}, {chr(39)},+${chr(39)}, {chr(39)}{chr(39)})')} || '|' || {norm(known(city))}"


def credential(x: str) -> str:
    cases = " ".join(
        f"when regexp_matches({strip(x)}, '(?i){pattern}') then '{name}'" for name, pattern in fv.CREDENTIAL_PATTERNS
    )
    return f"case {cases} else '' end"


def title_of(category: str) -> str:
    cases = " ".join(f"when '{c}' then '{t}'" for c, t in fv.TITLES.items())
    return f"case {category} {cases} else '' end"


def bad_label(x: str, extended: bool = True) -> str:
    patterns = fv.NOT_A_LABEL + (fv.NOT_A_LABEL_MORE if extended else ())
    return f"regexp_matches({known(x)}, '(?i)^(?:{'|'.join(patterns)})')"


def individual_label(x: str) -> str:
    return f"regexp_matches({known(x)}, '(?i){'|'.join(fv.ONE_PERSON)}')"


def word_list(x: str) -> str:
    """Words of a text already free of doubled blanks at its ends."""
    return f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"


def _three_ways(a: str, b: str) -> str:
    return f"{a} || ' ' || {b}, {b} || ' ' || {a}, {b} || ', ' || {a}"


def name_variants(source: str, last: str, first: str, cleaned: bool = False, out: str = "keys") -> str:
    """Select everything of a source plus the list of name keys."""
    prepare = clean_name if cleaned else (lambda c: strip_suffix(norm(c)))
    return (
        f"select *, case when l_ = '' and f_ = '' then [] when f_ = '' then [l_] "
        f"when l_ = '' then list_distinct([f_, split_part(f_, ' ', 1)]) "
        f"else list_distinct([{_three_ways('f_', 'l_')}, {_three_ways('f1_', 'l_')}]) end as {out} "
        f"from (select *, split_part(f_, ' ', 1) as f1_ from "
        f"(select *, {prepare(last)} as l_, {prepare(first)} as f_ from {source}))"
    )


def fullname_variants(
    source: str, x: str, min_words: int, keep_full: bool = True, cleaned: bool = False, out: str = "keys"
) -> str:
    keys = (
        f"list_concat([full_, base_], case when len(w_) >= {min_words} "
        f"then [{_three_ways('w_[1]', 'w_[-1]')}] else [] end)"
    )
    if cleaned:
        keys = f"list_transform({keys}, lambda k: {clean_name('k')})"
    full = "whole_" if keep_full else "bare_"
    return (
        f"select *, case when full_ = '' then [] else list_distinct({keys}) end as {out} from "
        f"(select *, {word_list('base_')} as w_ from "
        f"(select *, {full} as full_, case when bare_ = '' then {full} else bare_ end as base_ from "
        f"(select *, {strip_suffix('whole_')} as bare_ from (select *, {norm(x)} as whole_ from {source}))))"
    )


def mixed_keys(source: str, a: str, b: str, initials: bool = False, out: str = "keys") -> str:
    """Select everything of a source plus the ranked list of mixed name keys, null where a key is not usable."""

    def keys(last: str, first: str) -> list[str]:
        token = f"split_part({first}, ' ', 1)"
        listed = [f"{last} || '|' || {first}", f"{last} || '|' || {token}"]
        if initials:
            listed.append(f"{last} || '|~' || {token}[1:1]")
        return [f"case when {last} <> '' and {first} <> '' then {k} end" for k in listed]

    full = keys("s_", "h_") + keys("c_", "h_")
    if initials:
        full = [full[i] for i in (0, 1, 3, 4, 2, 5)]
    return (
        f"select *, case when contains(b_, ' ') then [{', '.join(full)}] else [{', '.join(keys('a_', 'b_'))}] end as {out} "
        f"from (select *, {clean_name('w_[-1]', True)} as s_, {clean_name('w_[1]', True)} as h_, "
        f"case when len(w_) >= 3 then {clean_name('w_[-2] || chr(32) || w_[-1]', True)} else '' end as c_ "
        f"from (select *, {word_list('b_')} as w_ "
        f"from (select *, {clean_name(a, True)} as a_, {clean_name(b, True)} as b_ from {source})))"
    )


def checked(x: str) -> str:
    return f"lower({strip(x)}) in ({', '.join(repr(t) for t in fv.CHECKED_TEXTS)})"


def pct(n: str, total: str) -> str:
    return f"round({n} / {total} * 100, 1)"
