"""Survey headers and answers. Header functions work on column names, answer functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.text import filled, strip


def checkbox_checked(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(*fv.CHECKED_TEXTS)


def answer(c: Column | str) -> Column:
    """The stripped answer, null when blank or "nan"."""
    s = strip(c)
    return F.when(~s.isin("", "nan"), s)


def collapse(text: str) -> str:
    return " ".join(text.split())


def choice_label(header: str) -> str:
    """The option named in a "(choice=...)" header, else the header."""
    found = re.search(r"\(choice=(.+?)\)\s*$", header)
    return found[1].strip() if found else header


def parent_question(header: str) -> str:
    """The question part of a checkbox header."""
    question = re.split(r"\s*\(select all that apply\)", header, maxsplit=1, flags=re.I)[0]
    return collapse(re.split(r"\s*\(choice=", question, maxsplit=1)[0])


def short_label(text: str, limit: int = 120) -> str:
    flat = collapse(text)
    return flat if len(flat) <= limit else flat[:limit] + "…"


def is_demographic(header: str) -> bool:
    return any(re.search(p, header, re.I) for p in fv.DEMOGRAPHIC_PATTERNS)


def scale_of(header: str) -> tuple[str, ...] | None:
    """The ordered answer scale of a known question."""
    for patterns, scale in ((fv.LIKERT_PATTERNS, fv.LIKERT), (fv.CONFIDENCE_PATTERNS, fv.CONFIDENCE)):
        if any(re.search(p, header, re.I) for p in patterns):
            return scale
    return None


def norm_question(c: Column | str) -> Column:
    """Strip a trailing ".1" left by duplicate headers."""
    return strip(F.regexp_replace(filled(c), r"\s*\.\d+\s*$", ""))


def question_class(c: Column | str) -> Column:
    """complete, screener, demographic or main."""
    q = filled(c)
    low = F.lower(q)
    return (
        F.when(q.rlike(r"(?i)Complete\?"), "complete")
        .when(low.rlike("|".join(fv.SCREENER_PATTERNS)), "screener")
        .when(low.rlike("|".join(fv.DEMOGRAPHIC_PATTERNS)), "demographic")
        .otherwise("main")
    )
