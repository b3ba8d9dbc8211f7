import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.operators import survey as ops

SCREENER = "Do you provide prenatal care?"
COLUMNS = [
    "Record ID", "Unnamed: 1", SCREENER, "Clinicians should screen", "Tools? (choice=Paper)", "Tools? (choice=Tablet)", "Please describe", "When",
    "What is the county of your practice?", "What is the county of your practice? .1", "Form Complete?",
]


@pytest.fixture
def answers(spark):
    rows = [
        (0, "r0", "x", " Yes", "Agree", "Checked", "", "text a", "2026-01-05 10:30", "st. louis", "", "Complete"),
        (1, "r1", "x", "yes", "Strongly agree", "0", "Unchecked", "0", "2026-01-06 11:30", "", "Ramsey", "Complete"),
        (2, "r2", "x", "no", "Unsure", "", "", "text b", "2026-01-07 12:30", "nan", "ST LOUIS", "Incomplete"),
        (3, "r3", "x", "YES", "Agree", "", "yes", "nan", "bad", "", "", "Complete"),
        (4, "r4", "x", "", "Later", "", "", "", "", "", "", ""),
    ]
    return spark.createDataFrame(rows, ["_ord", *COLUMNS])


def test_classify(answers):
    got = ops.classify_columns(answers)
    assert got.checkbox_groups == {"Tools?": ["Tools? (choice=Paper)", "Tools? (choice=Tablet)"]}
    assert got.timestamps == ["Unnamed: 1", "When"]
    assert got.system == ["Record ID", "Unnamed: 1", "When"]
    assert "Please describe" in got.free_text and "Clinicians should screen" in got.free_text  # 4 of 5 answers differ
    assert got.labels == {"Form Complete?": "Complete? [after: What is the county of your practice? .1]"}
    assert SCREENER in got.single


def test_frequencies_follow_scale_then_count(answers):
    got = ops.freq_single(answers, ["Clinicians should screen", SCREENER]).orderBy("question_order", "response_order").collect()
    assert [(r["response"], r["n"], r["pct"], r["n_answered"]) for r in got] == [
        ("Strongly agree", 1, 20.0, 5), ("Agree", 2, 40.0, 5), ("Later", 1, 20.0, 5), ("Unsure", 1, 20.0, 5),
        ("YES", 1, 25.0, 4), ("Yes", 1, 25.0, 4), ("no", 1, 25.0, 4), ("yes", 1, 25.0, 4)]


def test_a_question_with_very_many_answers_is_ranked_in_segments(spark):
    df = spark.range(30_000).select(F.concat(F.lit("a"), F.col("id") % 20_000).alias("Q"), F.lit("yes").alias("R"))
    got = ops.freq_single(df, ["Q", "R"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("__segment" in line for line in plan.splitlines() if "Window" in line)
    facts = got.where("question = 'Q'").agg(F.count("*"), F.max("response_order"), F.max("n_answered"), F.sum("n")).first()
    assert facts[:] == (20_000, 20_000, 30_000, 30_000)
    first = got.where("question = 'Q' and response_order in (1, 10001)").orderBy("response_order").collect()
    assert [(r.response, r.n) for r in first] == [("a0", 2), ("a10000", 1)]
    assert rows_of(got.where("question = 'R'"), "response", "n", "pct") == [("yes", 30_000, 100.0)]


def test_checkbox_base_is_rows_with_any_filled_box(answers):
    got = ops.freq_checkbox(answers, {"Tools?": ["Tools? (choice=Paper)", "Tools? (choice=Tablet)"]})
    assert rows_of(got, "response", "n", "pct", "n_answered") == [("Paper", 1, 33.3, 3), ("Tablet", 1, 33.3, 3)]


def test_split_and_all(answers):
    elig, inelig = ops.split_eligible(answers)
    assert (rows_of(elig, "_ord"), rows_of(inelig, "_ord")) == ([(0,), (1,), (3,)], [(2,), (4,)])
    everyone, nobody = ops.split_eligible(answers.select("_ord"))
    assert (everyone.count(), nobody.count()) == (5, 0)
    freqs = ops.freq_all(ops.with_group(answers), ops.classify_columns(answers))
    e, i = freqs.where("group = 'eligible'"), freqs.where("group = 'ineligible'")
    assert rows_of(ops.completion_pivot(e, i), "response", "Eligible", "Ineligible") == [("Complete", 3, 0), ("Incomplete", 0, 1)]
    assert rows_of(ops.screener_combined(e, i, "prenatal"), "response", "n", "pct") == [("YES", 1, 25.0), ("Yes", 1, 25.0), ("no", 1, 25.0), ("yes", 1, 25.0)]
    assert rows_of(ops.side_by_side(e, i, SCREENER), "response", "eligible_n", "ineligible_n", "ineligible_pct")[2] == ("no", 0, 1, 100.0)
    counts = ops.report_counts(e, i).first()
    assert counts["n_ineligible"] == 1 and counts["n_eligible"] == 3  # no question has the screener's full wording


def test_county(answers):
    rows = ops.county_answers(ops.with_group(answers))
    assert rows_of(rows, "group", "county_raw", "county_normalized") == [
        ("eligible", "Ramsey", "Ramsey"), ("eligible", "st. louis", "St Louis"), ("ineligible", "ST LOUIS", "St Louis")]
    table = [tuple(r) for r in ops.county_table(rows).collect()]
    assert table == [("St Louis", 1, 50.0, 1, 100.0, 2), ("Ramsey", 1, 50.0, 0, 0.0, 1), ("TOTAL", 2, 100.0, 1, 100.0, 3)]
    summary = [tuple(r) for r in ops.county_summary(rows, [("ramsey", "R")]).collect()]
    assert summary == [("St Louis", 1, 1, 2), ("R", 1, 0, 1)]


def test_free_text_and_times(answers):
    grouped = ops.with_group(answers)
    got = ops.free_text_long(grouped, ["Please describe", "What is the county of your practice?"], "Record ID", {"describe": [("text", "T")]})
    assert rows_of(got, "record_id", "group", "response", "response_clean") == [("r0", "eligible", "st. louis", "st. louis"), ("r0", "eligible", "text a", "T")]
    times = ops.submission_times(grouped, "When", "Record ID")
    assert rows_of(times, "record_id", "date", "day_of_week", "hour")[0] == ("r0", "2026-01-05", "Monday", 10)
    assert rows_of(ops.submission_range(times), "group", "submissions", "last_date") == [("eligible", 2, "2026-01-06"), ("ineligible", 1, "2026-01-07")]
