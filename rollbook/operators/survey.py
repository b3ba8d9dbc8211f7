"""Survey tabulation. All questions of one kind are tabulated in one pass over the answers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook import fixed_values as fv
from rollbook.functions.questions import (
    checkbox_checked, choice_label, collapse, is_demographic, norm_question, parent_question, question_class,
    scale_of, short_label,
)
from rollbook.functions.text import as_column, coalesce_blank, filled, normalize_county, strip
from rollbook.scale import segmented, stored

SINGLE = "Single choice"
MULTIPLE = "Select all that apply"
UNSCALED = 1 << 20  # rank of an answer outside its question's scale


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, halves rounded up."""
    return F.round(part / whole * 100, 1)


# --- who and what ------------------------------------------------------------------------------


def screener_column(df: DataFrame) -> str | None:
    for c in df.columns:
        if any(re.search(p, c, re.I) for p in fv.ELIGIBILITY_PATTERNS):
            return c
    return None


def with_group(df: DataFrame, screener: str | None = None) -> DataFrame:
    """Add `group`: eligible when the screener says yes, or when there is no screener; else ineligible."""
    column = screener or screener_column(df)
    if column is None:
        return df.withColumn("group", F.lit("eligible"))
    return df.withColumn("group", F.when(F.lower(strip(column)) == "yes", "eligible").otherwise("ineligible"))


def split_eligible(df: DataFrame, screener: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = with_group(df, screener)
    return rows.where("group = 'eligible'").drop("group"), rows.where("group = 'ineligible'").drop("group")


@dataclass
class ColumnClasses:
    """What each survey column is. `labels` gives the shown name of form-status columns."""

    checkbox_groups: dict[str, list[str]] = field(default_factory=dict)
    free_text: list[str] = field(default_factory=list)
    timestamps: list[str] = field(default_factory=list)
    system: list[str] = field(default_factory=list)
    complete: list[str] = field(default_factory=list)
    single: list[str] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)


def _answers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., position, question, value) of the filled answers."""
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("question"), strip(c).alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*keep, F.explode(listed).alias("a")).select(*keep, "a.*").where("value <> ''")


def column_facts(df: DataFrame, columns: Sequence[str], order_by: str = "_ord") -> DataFrame:
    """Per column: filled answers, distinct answers, and how many of the first twenty look like timestamps."""
    long = _answers(df, columns, [order_by])
    values = long.groupBy("position", "question", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("position", "question").agg(
        F.sum("n").alias("answers"), F.count(F.lit(1)).alias("distinct_answers")
    )
    head = long.withColumn("at", F.row_number().over(Window.partitionBy("question").orderBy(order_by))).where("at <= 20")
    stamps = head.groupBy("question").agg(
        F.count(F.lit(1)).alias("head"), F.count_if(F.col("value").rlike(fv.TIMESTAMP_TEXT)).alias("stamps")
    )
    return counts.join(stamps, "question")


def classify_columns(df: DataFrame, order_by: str = "_ord") -> ColumnClasses:
    """Sort the columns into classes by name and by content.

    The facts come from one long-form aggregation; one row per column reaches the driver.
    """
    columns = [c for c in df.columns if c != order_by]
    out = ColumnClasses()
    for c in columns:
        if "(choice=" in c:
            out.checkbox_groups.setdefault(parent_question(c), []).append(c)
    boxes = {c for group in out.checkbox_groups.values() for c in group}
    facts = {r["question"]: r for r in column_facts(df, [c for c in columns if c not in boxes], order_by).collect()}

    def free_text(c: str) -> bool:
        if c in boxes or is_demographic(c):
            return False
        if re.search(fv.FREE_TEXT_NAME, c, re.I) or c.strip() == "Specify":
            return True
        f = facts.get(c)
        return bool(f and f["answers"] >= 5 and f["distinct_answers"] / f["answers"] > 0.7)

    def timestamp(c: str) -> bool:
        f = facts.get(c)
        return bool(re.match(fv.UNNAMED_COLUMN, c.strip()) or (f and f["head"] >= 3 and f["stamps"] / f["head"] > 0.5))

    out.free_text = [c for c in columns if free_text(c)]
    out.timestamps = [c for c in columns if timestamp(c)]
    out.system = [c for c in columns if c.strip() in ("Record ID", "") or c in out.timestamps]

    def status(c: str) -> bool:
        return bool(re.search(fv.COMPLETE_NAME, c.strip(), re.I))

    out.complete = [c for c in columns if status(c) and c.strip() not in ("Record ID", "")]
    for c in out.complete:
        at = columns.index(c)
        before = [p for p in columns[:at] if p.strip() and p not in out.system and not status(p)]
        out.labels[c] = f"Complete? [after: {short_label(before[-1], 60)}]" if before else f"Complete? [col {at}]"
    skipped = boxes | set(out.free_text) | set(out.system)
    out.single = [c for c in columns if c not in skipped]
    return out


# --- frequencies -------------------------------------------------------------------------------


def freq_single(
    df: DataFrame,
    columns: Sequence[str],
    scales: Mapping[str, Sequence[str]] | None = None,
    by: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    positions: Mapping[str, int] | None = None,
) -> DataFrame:
    """question, type, response, n, pct, n_answered, question_order, response_order for single-choice columns.

    Known scales come in scale order, then every other answer by count and text. One long-form pass counts the answers;
    only those counts are ranked and added up, in segments of bounded size.
    """
    at = {c: (positions or {}).get(c, i) for i, c in enumerate(columns)}
    entries = [
        F.struct(
            F.lit(at[c]).alias("question_order"), F.lit(collapse((labels or {}).get(c, c))).alias("question"),
            strip(c).alias("response"),
        )
        for c in columns
    ]
    keys = [*by, "question_order", "question"]
    counts = (
        df.select(*by, F.explode(F.array(*entries)).alias("e"))
        .select(*by, "e.*")
        .where(~F.col("response").isin("", "nan"))
        .groupBy(*keys, "response")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # ranks of known answers, looked up on the counted rows only
    ranks = {}
    for c in columns:
        for j, option in enumerate((scales or {}).get(c) or scale_of(c) or ()):
            ranks[f"{at[c]}|{option}"] = j
    rank = F.lit(UNSCALED)
    if ranks:
        table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
        own = F.concat_ws("|", F.col("question_order").cast("string"), "response")
        rank = F.coalesce(F.try_element_at(table, own), rank)
    counts = stored(counts.withColumn("scale", rank), "answer-counts")
    # a question with very many different answers is numbered over as many segments as they need
    ranked = segmented(counts, keys, [F.asc("scale"), F.desc("n"), F.asc("response")], "response_order")
    totals = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("n").alias("n_answered"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return ranked.join(totals, same).select(
        *by, "question", F.lit(SINGLE).alias("type"), "response", "n", percent(F.col("n"), F.col("n_answered")).alias("pct"), "n_answered",
        "question_order", F.col("response_order").cast("int").alias("response_order"),
    )


def freq_checkbox(
    df: DataFrame, groups: Mapping[str, Sequence[str]], by: Sequence[str] = (), positions: Mapping[str, int] | None = None
) -> DataFrame:
    """question, type, response, n, pct, n_answered ... for checkbox groups; the base is rows with any filled box.

    All groups are counted by one aggregation.
    """
    aggs, listed = [], []
    for g, (question, children) in enumerate(groups.items()):
        touched = F.lit(False)
        for c in children:
            touched = touched | (strip(c) != "")
        aggs.append(F.count_if(touched).alias(f"d{g}"))
        for i, c in enumerate(children):
            aggs.append(F.count_if(checkbox_checked(c)).alias(f"n{g}_{i}"))
            listed.append(
                F.struct(
                    F.lit(collapse(question)).alias("question"), F.lit(MULTIPLE).alias("type"),
                    F.lit(choice_label(c)).alias("response"), F.col(f"n{g}_{i}").alias("n"),
                    F.col(f"d{g}").alias("n_answered"), F.lit((positions or {}).get(question, g)).alias("question_order"),
                    F.lit(i + 1).alias("response_order"),
                )
            )
    one = df.groupBy(*by).agg(*aggs)
    rows = one.select(*by, F.explode(F.array(*listed)).alias("r")).select(*by, "r.*").where("n_answered > 0")
    return rows.select(
        *by, "question", "type", "response", "n", percent(F.col("n"), F.col("n_answered")).alias("pct"), "n_answered",
        "question_order", "response_order",
    )


def freq_all(df: DataFrame, classes: ColumnClasses, by: Sequence[str] = ("group",)) -> DataFrame:
    """Both kinds of questions in the order of the survey, for each group of respondents."""
    at = {c: i for i, c in enumerate(df.columns)}
    positions = {q: min(at[c] for c in children) for q, children in classes.checkbox_groups.items()}
    single = freq_single(df, classes.single, None, by, classes.labels, at)
    if not classes.checkbox_groups:
        return single
    return single.unionByName(freq_checkbox(df, classes.checkbox_groups, by, positions))


# --- county, free text, time -------------------------------------------------------------------


def county_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.search(fv.COUNTY_PATTERN, c, re.I) and "(choice=" not in c]


def county_answers(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """group, county_raw and county_normalized from the first filled county column."""
    raw = coalesce_blank(*(columns or county_columns(df)))
    rows = df.select(*keep, "group", raw.alias("county_raw")).where("county_raw <> ''")
    return rows.withColumn("county_normalized", normalize_county("county_raw"))


def county_table(answers: DataFrame) -> DataFrame:
    """Per county eligible and ineligible n and %, and the total; with a TOTAL row, which comes last."""
    counts = (
        answers.groupBy(F.col("county_normalized").alias("county"))
        .pivot("group", ["eligible", "ineligible"])
        .agg(F.count(F.lit(1)))
        .fillna(0)
        .rollup("county")
        .agg(
            F.sum("eligible").alias("eligible_n"),
            F.sum("ineligible").alias("ineligible_n"),
            F.grouping("county").alias("is_total"),
        )
    )

    def share(n: str, group: str) -> Column:
        total = answers.agg(F.count_if(F.col("group") == group)).scalar()
        return F.when(total > 0, percent(F.col(n), total))

    return counts.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("county")).alias("county"),
        "eligible_n", share("eligible_n", "eligible").alias("eligible_pct"),
        "ineligible_n", share("ineligible_n", "ineligible").alias("ineligible_pct"),
        (F.col("eligible_n") + F.col("ineligible_n")).alias("total_n"), "is_total",
    ).orderBy("is_total", F.desc("total_n"), "county").drop("is_total")


def recode(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | str | None = None) -> Column:
    """The first rule whose pattern is found in the text (ignoring case), else the default."""
    text = filled(c)
    out = filled(default) if default is not None else text
    for pattern, value in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), value).otherwise(out)
    return out


def county_summary(answers: DataFrame, rules: Sequence[tuple[str, str]] = (), groups: Sequence[str] = ("eligible", "ineligible")) -> DataFrame:
    """Recoded county by group, zero-filled, with the total, most frequent first."""
    clean = recode("county_raw", rules, "county_normalized")
    counts = (
        answers.groupBy(clean.alias("county_clean")).pivot("group", list(groups)).agg(F.count(F.lit(1))).fillna(0)
    )
    total = F.lit(0)
    for g in groups:
        total = total + F.col(g)
    return counts.withColumn("total", total).orderBy(F.desc("total"), "county_clean")


def free_text_long(
    df: DataFrame,
    columns: Sequence[str],
    record_id: str | None = None,
    rules: Mapping[str, Sequence[tuple[str, str]]] | None = None,
) -> DataFrame:
    """record_id, group, question, response, recode, response_clean; main questions from eligible rows only."""
    keep = [as_column(record_id).alias("record_id")] if record_id else []
    names = ["record_id"] if record_id else []
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(short_label(c)).alias("question"), strip(c).alias("response"),
                F.lit(is_demographic(c)).alias("everyone"),
            )
            for i, c in enumerate(columns)
        ]
    )
    rows = df.select(*keep, "group", F.explode(listed).alias("a")).select(*names, "group", "a.*")
    rows = rows.where(
        (F.col("everyone") | (F.col("group") == "eligible")) & ~F.lower("response").isin(*fv.NO_ANSWER_TEXTS)
    )
    clean = F.col("response")
    for pattern, cases in (rules or {}).items():
        clean = F.when(F.lower("question").rlike(pattern), recode("response", cases)).otherwise(clean)
    return rows.select(
        *names, "group", "question", "response", F.lit("").alias("recode"), clean.alias("response_clean"),
        F.col("position").alias("question_order"),
    )


def submission_times(df: DataFrame, stamp: str, record_id: str) -> DataFrame:
    """record_id, group, submitted_at, date, day_of_week and hour of every answer that parses as a time."""
    parsed = F.coalesce(
        F.try_to_timestamp(filled(stamp)), F.try_to_timestamp(filled(stamp), F.lit("yyyy-MM-dd HH:mm"))
    )
    rows = df.select(filled(record_id).alias("record_id"), "group", parsed.alias("t")).where("t is not null")
    return rows.select(
        "record_id", "group",
        F.date_format("t", "yyyy-MM-dd HH:mm").alias("submitted_at"),
        F.date_format("t", "yyyy-MM-dd").alias("date"),
        F.date_format("t", "EEEE").alias("day_of_week"),
        F.hour("t").alias("hour"),
    )


def submission_range(times: DataFrame) -> DataFrame:
    return times.groupBy("group").agg(
        F.count(F.lit(1)).alias("submissions"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


# --- report tables over frequency tables -------------------------------------------------------


def _one_side(freqs: DataFrame, question: str, prefix: str) -> DataFrame:
    rows = freqs.where(norm_question("question") == question)
    base = rows.groupBy("response").agg(F.sum("n").alias("n"))
    most = rows.agg(F.max("n_answered")).scalar()
    return base.select("response", F.col("n").alias(f"{prefix}_n"), percent(F.col("n"), most).alias(f"{prefix}_pct"))


def side_by_side(elig: DataFrame, inelig: DataFrame, question: str) -> DataFrame:
    """Answers of one question in both groups. Repeated answers are summed; % is of the largest N; missing is 0."""
    both = _one_side(elig, question, "eligible").join(_one_side(inelig, question, "ineligible"), "response", "full")
    return both.fillna(0, [c for c in both.columns if c != "response"])


def screener_combined(elig: DataFrame, inelig: DataFrame, pattern: str) -> DataFrame:
    """Pooled counts of the questions that match, % of the pooled total, most frequent first."""
    rows = elig.unionByName(inelig, allowMissingColumns=True).where(F.lower("question").rlike(pattern))
    counts = rows.groupBy("response").agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total)).orderBy(F.desc("n"), "response")


def completion_pivot(elig: DataFrame, inelig: DataFrame) -> DataFrame:
    """Form status by group: form, response, Eligible, Ineligible."""

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(question_class("question") == "complete")
        return rows.select(F.lit(name).alias("group"), F.col("question").alias("form"), "response", "n")

    stacked = side(elig, "Eligible").unionByName(side(inelig, "Ineligible"))
    return stacked.groupBy("form", "response").pivot("group", ["Eligible", "Ineligible"]).agg(F.sum("n")).fillna(0)


def report_counts(elig: DataFrame, inelig: DataFrame) -> DataFrame:
    """One row: eligible N (the screener's yes answer, else the largest N) and ineligible N (the largest N)."""
    yes = F.lower("question").rlike(fv.SCREENER_PATTERNS[0]) & F.lower("response").rlike("^yes")
    first_yes = F.min_by(F.when(yes, F.col("n")), F.when(yes, F.struct("question_order", "response_order")))
    left = elig.agg(F.coalesce(first_yes, F.max("n_answered")).alias("eligible"))
    right = inelig.agg(F.max("n_answered").alias("ineligible"))
    rows = left.unionByName(right, allowMissingColumns=True)
    return rows.agg(F.max("eligible").alias("n_eligible"), F.max("ineligible").alias("n_ineligible"))
