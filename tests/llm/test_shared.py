"""What workers keep, and the session's settings."""

import threading
import time

import numpy as np
import pytest

import corpus_pipeline
from rollbook.llm import shared, tokens
from test_operators import docs, empty  # noqa: F401  (fixtures)

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def clean():
    shared.KEPT.clear()
    yield
    shared.KEPT.clear()


def test_another_operator_takes_the_place_of_what_was_kept(clean):
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert shared.kept("one", "a", make("a")) == shared.kept("one", "a", make("again")) == "a"
    assert shared.kept("one", "b", make("b")) == "b" and len(shared.KEPT) == 2
    assert shared.kept("two", "a", make("c")) == "c" and list(shared.KEPT) == [("two", "a")]
    assert made == ["a", "b", "c"]


def test_an_idle_worker_lets_go(clean, monkeypatch):
    monkeypatch.setattr(shared, "IDLE_SECONDS", 0.5)
    shared.kept("one", "a", object)
    assert any(t.daemon and t.is_alive() for t in threading.enumerate())
    for _ in range(40):
        if not shared.KEPT:
            break
        time.sleep(0.2)
    assert not shared.KEPT and shared.kept("one", "a", lambda: 5) == 5


def test_small_batches_put_the_setting_back(spark):
    before = spark.conf.get(BATCH)
    with shared.small_batches(spark, 7):
        assert spark.conf.get(BATCH) == "7"
    assert spark.conf.get(BATCH) == before
    with pytest.raises(ZeroDivisionError), shared.small_batches(spark):
        1 / 0
    assert spark.conf.get(BATCH) == before


def test_stages_leave_the_settings_alone(spark, docs):  # noqa: F811
    before = dict(spark.conf.getAll)
    table = spark.read.parquet(f"{docs}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, table, docs)
    after = dict(spark.conf.getAll)
    assert after.get(BATCH, "") == before.get(BATCH, "")


def test_index_arrays_of_an_encoder_are_small(spark):
    found, before = tokens._expand(np.array([5, 0, 9]), np.array([2, 0, 3]))
    assert found.tolist() == [5, 6, 9, 10, 11] and before.tolist() == [0, 2, 2, 5] and found.itemsize == 4
    far, _ = tokens._expand(np.array([1 << 31]), np.array([2]))
    assert far.tolist() == [1 << 31, (1 << 31) + 1]
    assert tokens._expand(np.array([], int), np.array([], int))[0].tolist() == []
    with shared.small_batches(spark):
        assert int(spark.conf.get(BATCH)) <= 500


def test_only_the_wanted_rows_stay(spark):
    numbers = [0, 1, -1, (1 << 18) - 1, 1 << 18, (1 << 33) + 5, (3 << 33) + (1 << 18), (512 << 33) + 7, -(1 << 62), (1 << 63) - 1]
    rows = spark.createDataFrame([(n, f"t{n}") for n in [*numbers, *numbers[:3], 2, 1 << 19, None]], "id long, text string")
    for wanted in (numbers, numbers[::2], numbers[1::2] * 2, [None], []):
        ids = spark.createDataFrame([(n,) for n in wanted], "wanted long")
        found = sorted(r.id for r in shared.only(rows, "id", ids).collect())
        assert found == sorted(n for n in [*numbers, *numbers[:3]] if n in wanted)
