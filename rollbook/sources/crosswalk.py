"""ZIP-to-county crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.text import fips5, title_case, zip5
from rollbook.sources.columns import resolve_roles


def load_crosswalk(df: DataFrame) -> DataFrame:
    """(zip5, county_name, county_fips), one row per ZIP.

    A ZIP that lies in several counties keeps the longest county name; ties go to the alphabetically first name, then
    code. The choice is one partially aggregated `min_by`, so a frequent ZIP is reduced before the shuffle.
    """
    roles = resolve_roles(df, fv.CROSSWALK_ROLES)
    county = title_case(roles["county"]) if roles["county"] else F.lit("")
    fips = fips5(roles["fips"]) if roles["fips"] else F.lit("")
    code = zip5(roles["zip"]) if roles["zip"] else F.lit("")
    rows = df.select(code.alias("zip5"), county.alias("county_name"), fips.alias("county_fips"))
    best = F.min(
        F.struct((-F.length("county_name")).alias("rank"), F.col("county_name"), F.col("county_fips"))
    ).alias("best")
    return rows.groupBy("zip5").agg(best).select("zip5", "best.county_name", "best.county_fips")
