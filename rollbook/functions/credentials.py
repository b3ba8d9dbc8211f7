"""Credentials, display titles and taxonomy texts (native columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.text import filled, let, strip


def norm_credential(c: Column | str) -> Column:
    """Broad category of a credential or license text; the first pattern that matches wins, '' if none does."""
    return F.coalesce(_category(c), F.lit(""))


def _category(c: Column | str) -> Column:
    chain = F
    for category, pattern in fv.CREDENTIAL_PATTERNS:
        chain = chain.when(filled(c).rlike("(?iU)" + pattern), category)
    return chain


def first_credential(cols: Sequence[Column | str]) -> Column:
    """The first non-blank category over the columns, null if there is none."""
    if not cols:
        return F.lit(None).cast("string")
    return F.coalesce(*[_category(c) for c in cols])


def title_of(category: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in fv.TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, category), F.lit(""))


def display_title(cols: Sequence[Column | str]) -> Column:
    """Dr, PA, NP, CNM, CNS, CRNA or RN from the first credential column that says so."""
    return title_of(first_credential(cols))


def parse_taxonomy(c: Column | str) -> Column:
    """The first entry of a ;-list, split at its first comma into (specialty, subspecialty); "(empty)" is blank."""
    whole = F.regexp_replace(filled(c), r"(?U)^\s*\(empty\)\s*$", "")
    head = F.regexp_extract(whole, r"(?U)^[\s;]*([^;]*?)\s*(?:;|$)", 1)
    return let(
        head,
        lambda h: F.struct(
            strip(F.substring_index(h, ",", 1)).alias("specialty"),
            F.when(F.instr(h, ",") > 0, strip(F.substr(h, F.instr(h, ",") + 1))).otherwise("").alias("subspecialty"),
        ),
    )


def boards_or_taxonomy(boards: Column | str, certification: Column | str, taxonomy: Column | str) -> Column:
    """(specialty, subspecialty) from the boards text when it is filled, else from the taxonomy text."""
    empty = r"(?U)^\s*\(empty\)\s*$|^\s+|\s+$"
    named = F.struct(
        F.regexp_replace(filled(boards), empty, "").alias("specialty"),
        F.regexp_replace(filled(certification), empty, "").alias("subspecialty"),
    )
    return F.when(filled(boards).rlike(r"(?U)^\s*(?:\(empty\)\s*)?$"), parse_taxonomy(taxonomy)).otherwise(named)

