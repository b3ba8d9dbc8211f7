"""Tests on organisation labels and place records (native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.addresses import is_po_box
from rollbook.functions.text import as_column, filled, known, let, strip


def _starts_with_any(c: Column, patterns: tuple[str, ...], lead: str = "") -> Column:
    return c.rlike(rf"(?iU)^{lead}(?:{'|'.join(patterns)})")


def is_org_name(c: Column | str) -> Column:
    """Starts with a letter and is no PO box, suite, attention line or missing-value word."""
    text = filled(c)
    return text.rlike(r"(?U)^\s*[a-zA-Z]") & ~is_po_box(text) & ~_starts_with_any(text, fv.NOT_A_LABEL, r"\s*")


def is_bad_label(c: Column | str, extended: bool = True) -> Column:
    """Noise such as suites or attention lines; `extended` adds mail codes, departments and sort marks.

    Every alternative is tried at the start of the text only.
    """
    return _starts_with_any(known(c), fv.NOT_A_LABEL + (fv.NOT_A_LABEL_MORE if extended else ()))


def is_individual_label(c: Column | str) -> Column:
    return known(c).rlike("(?iU)" + "|".join(fv.ONE_PERSON))


def canonical_practice(c: Column | str) -> Column:
    return let(
        known(c),
        lambda s: F.when(F.lower(s).isin(*fv.SOLO_WORDS), fv.SOLO)
        .when(F.lower(s).isin(*fv.GROUP_WORDS), fv.GROUP)
        .otherwise(s),
    )


def place_label(name: Column | str, types: Column | str, primary_type: Column | str, address: Column | str) -> Column:
    """A place record to (label, city): real estate is marked, medical names or types are accepted, others are blank.

    The city is the third-last part of the address, or the second-last when there are only two.
    """
    text = filled(name)
    city = let(
        F.split(filled(address), ","),
        lambda parts: F.when(F.size(parts) >= 3, strip(F.get(parts, F.size(parts) - 3)))
        .when(F.size(parts) == 2, strip(F.get(parts, F.lit(0))))
        .otherwise(""),
    )
    medical = (
        text.rlike("(?iU)" + fv.MEDICAL_WORDS)
        | filled(primary_type).isin(*fv.MEDICAL_TYPES)
        | F.coalesce(F.arrays_overlap(as_column(types), F.array(*[F.lit(t) for t in fv.MEDICAL_TYPES])), F.lit(False))
    )
    label = F.when(text.rlike("(?iU)" + fv.REAL_ESTATE_WORDS), fv.REAL_ESTATE_LABEL).when(medical, text).otherwise("")
    return F.struct(label.alias("label"), city.alias("city"))
