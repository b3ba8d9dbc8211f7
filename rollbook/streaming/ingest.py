"""Continuous ingestion of course documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook import fixed_values as fv
from rollbook.operators.retrieval import build_catalog, new_courses, numbered_chunks, parse_courses
from rollbook.sources.tables import document_text


def append_new_courses(
    docs: DataFrame, catalog_path: str, chunks_path: str, size: int, overlap: int, order_by: str = "file_name",
    batch: int = 0,
) -> None:
    """Parse a batch and append the courses that the stored catalog lacks.

    Chunks go first and under a folder named by the batch and its content, so a repeated batch overwrites its own chunks
    and a stream that starts anew overwrites none; the catalog entry that hides a course from later batches is written
    last. New courses are those of the catalog's files as listed here, so parts computed again come out the same.
    """
    spark = docs.sparkSession
    courses = parse_courses(docs)
    catalog = _read(spark, catalog_path)
    fresh = new_courses(courses, catalog, order_by).persist()
    try:
        mark = fresh.agg(F.hex(F.bit_xor(F.xxhash64("title")))).first()[0]
        if mark is None:
            return
        numbered_chunks(fresh, size, overlap).write.mode("overwrite").parquet(f"{chunks_path}/batch={batch}-{mark}")
        build_catalog(fresh, order_by).write.mode("append").parquet(catalog_path)
    finally:
        fresh.unpersist()


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(hadoop_path) else None


def ingest_stream(
    docs: DataFrame,
    catalog_path: str,
    chunks_path: str,
    checkpoint: str,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    order_by: str = "file_name",
    trigger: dict | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start the ingestion of a stream of (file_name, text). Restarting is safe: known titles are skipped.

    Of several documents with one title in a batch the first by `order_by` counts.
    """

    def batch(df: DataFrame, number: int) -> None:
        append_new_courses(df, catalog_path, chunks_path, size, overlap, order_by, number)
        if then:
            then(df, number)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def document_stream(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt",)) -> DataFrame:
    """Whole text files arriving in a folder as (file_name, text)."""
    pattern = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    raw = spark.readStream.text(path, wholetext=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), document_text("value").alias("text"))
