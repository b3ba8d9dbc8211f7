from conftest import rows_of
from pyspark.sql import functions as F

from rollbook.streaming.history import session_history_stream
from rollbook.streaming.ingest import document_stream, ingest_stream


def test_ingestion_adds_unseen_courses_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    catalog, chunks, checkpoint = (str(tmp_path / n) for n in ("catalog", "chunks", "checkpoint"))

    def run(where=checkpoint):
        ingest_stream(document_stream(spark, str(inbox)), catalog, chunks, where).awaitTermination()
        return rows_of(spark.read.parquet(catalog), "title", "lesson_count"), spark.read.parquet(chunks).count()

    (inbox / "a.txt").write_text("Course Title: A\n\n\nLesson 1: x\nText.")
    assert run() == ([("A", 1)], 1)
    (inbox / "b.txt").write_text("Course Title: A\n\n\nLesson 1: x\nOther text.")
    (inbox / "c.txt").write_text("Course Title: C\n\n\nBody. More body.")
    assert run() == ([("A", 1), ("C", 0)], 3)
    # a lost checkpoint replays every file; the catalog keeps the result the same
    assert run(str(tmp_path / "fresh")) == ([("A", 1), ("C", 0)], 3)


def test_history_state_spans_batches_and_expires(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, turn long, role string, content string, ts timestamp"

    def add(*rows):
        df = spark.createDataFrame([(s, t, "user", f"{s}{t}", m * 60) for s, t, m in rows], "session_id string, turn long, role string, content string, s long")
        df.select("session_id", "turn", "role", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        stream = session_history_stream(spark.readStream.schema(schema).parquet(source), n=1, keep_minutes=60)
        writer = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
        latest = spark.read.parquet(out).groupBy("session_id").agg(F.max_by("history", "batch").alias("h"))
        return dict(rows_of(latest, "session_id", "h"))

    add(("a", 0, 1000), ("a", 2, 1002), ("a", 1, 1001), ("b", 0, 1000))
    assert run() == {"a": "User: a1\nUser: a2", "b": "User: b0"}
    add(("a", 3, 1003))
    assert run()["a"] == "User: a2\nUser: a3"
    # far later: the watermark passes both sessions, their state goes, and a new message starts afresh
    add(("z", 0, 5000))
    run()
    add(("b", 9, 5001))
    assert run()["b"] == "User: b9"


def test_late_and_resumed_sessions_keep_their_history(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, turn long, role string, content string, ts timestamp"

    def run(*rows):
        df = spark.createDataFrame([(s, t, "user", f"{s}{t}", m * 60) for s, t, m in rows], "session_id string, turn long, role string, content string, s long")
        df.select("session_id", "turn", "role", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)

        def keep(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        stream = session_history_stream(spark.readStream.schema(schema).parquet(source), n=1)
        writer = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
        latest = spark.read.parquet(out).groupBy("session_id").agg(F.max_by("history", "batch").alias("h"))
        return dict(rows_of(latest, "session_id", "h"))

    run(("a", 0, 1000))
    run(("z", 0, 9000))
    assert run(("late", 0, 10), ("a", 1, 9001)) == {"a": "User: a0\nUser: a1", "late": "User: late0", "z": "User: z0"}
