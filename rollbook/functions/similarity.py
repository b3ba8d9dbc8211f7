"""String similarity of two columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rollbook.functions.text import filled


@F.pandas_udf(DoubleType())
def _matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], index=a.index, dtype="float64")


@F.pandas_udf(DoubleType())
def _best_of_pairs(own: pd.Series, theirs: pd.Series) -> pd.Series:
    def best(a, b):
        if a is None or b is None:
            return None
        return max((SequenceMatcher(None, x, y).ratio() for x in a for y in b), default=0.0)

    return pd.Series([best(a, b) for a, b in zip(own, theirs)], index=own.index, dtype="float64")


def best_ratio(own: Column, theirs: Column, method: str = "blocks") -> Column:
    """The best `seq_ratio` between two arrays of strings; null when either array is null, 0 without a pair."""
    if method == "blocks":
        return _best_of_pairs(own, theirs)
    best = F.array_max(F.transform(own, lambda a: F.array_max(F.transform(theirs, lambda b: seq_ratio(a, b, method)))))
    return F.when(own.isNotNull() & theirs.isNotNull(), F.coalesce(best, F.lit(0.0)))


def seq_ratio(a: Column | str, b: Column | str, method: str = "blocks") -> Column:
    """Similarity between 0 and 1, meant for pairs that already met in an equality join.

    blocks  matching-blocks ratio (Arrow UDF)
    lev     1 - levenshtein / longer length (native, a different metric)
    """
    x, y = filled(a), filled(b)
    if method == "blocks":
        return _matching_blocks_ratio(x, y)
    if method == "lev":
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)
    raise ValueError(f"unknown method {method!r}; blocks or lev")
