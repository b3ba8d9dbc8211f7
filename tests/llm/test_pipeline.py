"""The pipeline against its parts, on a small table with copies, secrets, toxic and unreadable documents."""

import corpus_pipeline
from test_operators import docs, empty  # noqa: F401  (fixtures)

from rollbook.llm import language, simhash, toxicity


def test_stages_take_effect(spark, docs):  # noqa: F811
    table = spark.read.parquet(f"{docs}/documents.parquet")
    model = toxicity.fit_documents(table, spark.read.parquet(f"{docs}/labels.parquet"))
    kept = table.filter(toxicity.toxicity(model, "text") < 0.5)
    known = kept.filter(~language.language(language.fit_documents(kept), "text")["rejected"])
    groups = {r.component_id for r in simhash.near_copies(known).collect() if r.component_id is not None}
    rows = corpus_pipeline.run(spark, docs).collect()
    found = {r.doc_id for r in rows}
    assert len(found - {None}) == len(groups) and found - {None} <= {r.doc_id for r in known.collect()}
    assert not found & {100, 101, 102}
    assert sum(r.doc_id == 7 and r.start == 0 for r in rows) <= 1


def test_all_but_the_last_stage_keep_the_columns(spark, docs):  # noqa: F811
    table = spark.read.parquet(f"{docs}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, docs).columns == table.columns


def test_an_empty_table(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).count() == 0
