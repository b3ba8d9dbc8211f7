"""Models learn from whole texts, however long."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from rollbook.llm import toxicity


def plain(rng, n):
    return " ".join("".join(rng.choice("th er on an re he in ed".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_toxic_words_behind_long_prefixes_are_learned(spark):
    rng = random.Random(2)
    long = plain(rng, 25_000)
    assert len(long) > 100_000
    rows = [(n, f"{long} {plain(rng, 5)} scumbag {plain(rng, 5)}", 1) for n in range(12)]
    rows += [(n, f"{long} {plain(rng, 10)} wholesome {plain(rng, 5)}", 0) for n in range(12, 36)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    scores = model.scores(pa.array(["he scumbag ran", "he wholesome ran", rows[0][1], rows[20][1]]))
    assert [s >= 0.5 for s in scores] == [True, False, True, False]
    local = toxicity.fit([t for _, t, k in rows if k], [t for _, t, k in rows if not k])
    assert (local.weights, local.threshold) == (model.weights, model.threshold)


def test_fitting_takes_no_words_of_documents_to_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(n, f"{plain(rng, 400)} {'Scumbag, ' * (n % 3 == 0)}{plain(rng, 400)}", int(n % 3 == 0)) for n in range(90)]
    rows += [(90, None, 0), (91, "", 1), (92, "12 34", 0), (93, "É", 1), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    order = [F.xxhash64(F.lit("fit"), "doc_id"), "doc_id"]
    ordered = df.orderBy(*order).collect()
    local = toxicity.fit([r.text for r in ordered if r.toxic], [r.text for r in ordered if not r.toxic])
    frame, sent = type(df), []
    for name, size in (("collect", lambda found: len(repr(found))), ("toArrow", lambda found: found.nbytes), ("toPandas", lambda found: found.memory_usage(deep=True).sum())):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), size=size: (out := f(self, *a), sent.append(size(out)))[0])
    model = toxicity.fit_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert sent and sum(sent) < sum(len(t or "") for _, t, _ in rows) / 3
    assert (local.contents, local.weights, local.threshold) == (model.contents, model.weights, model.threshold)
    assert model.scores(pa.array(["he scumbag ran", "he ran"])).round().tolist() == [1, 0]
