"""Delimited files, unions of files, directories of named tables, and documents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.text import as_column, filled, strip, zip5
from rollbook.sources.columns import resolve


def _kinds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, broken, multi_line) of every file of delimited text, found in one pass over the whole of it.

    broken      some line is not valid UTF-8
    multi_line  some line has an odd number of quotes, so a field runs over a line end and the file can't be split
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    text = spark.read.text(path)
    file = text.metadataColumn("_metadata")["file_path"]
    return text.groupBy(file.alias("file")).agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"), F.bool_or(quotes % 2 == 1).alias("multi_line")
    )


def _encoding(broken: bool) -> str:
    """UTF-8, or ISO-8859-1, which always decodes."""
    return "ISO-8859-1" if broken else "UTF-8"


def probe(spark: SparkSession, path: str | list[str]) -> tuple[str, bool]:
    """(encoding, multi_line) that every file of the path can be read with."""
    found = _kinds(spark, path).agg(F.bool_or("broken").alias("broken"), F.bool_or("multi_line").alias("multi_line")).first()
    return _encoding(found["broken"]), bool(found["multi_line"])


def _literal_path(file: str) -> str:
    """A file path as the readers take it: decoded, and without pattern characters."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


#: Where a row stands in its input: file, start of the block that one task reads, row within it.
PLACE = ("__path", "__block", "__row")


def _read_placed(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None,
    column_map: Mapping[str, str] | None,
    sep: str = ",",
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text as in `read_delimited`, and the columns `PLACE`.

    Files that differ in encoding or in fields over several lines are read apart, so one such file changes no other.
    """
    if encoding is None or multi_line is None:
        kinds = _kinds(spark, path).groupBy("broken", "multi_line").agg(F.sort_array(F.collect_list("file")).alias("files"))
        parts = [
            (encoding or _encoding(k["broken"]), k["multi_line"] if multi_line is None else multi_line, k["files"])
            for k in kinds.orderBy("broken", "multi_line").collect()
        ]
    else:
        parts = [(encoding, multi_line, [])]
    renames = column_map or {}
    combined = None
    for own, lines, files in parts or [("UTF-8", False, [])]:
        df = (
            spark.read.option("header", True)
            .option("inferSchema", False)
            .option("encoding", own)
            .option("sep", sep)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", lines)
            .csv([_literal_path(f) for f in files] if len(parts) > 1 else path)
        )
        place = df.metadataColumn("_metadata")
        where = (place["file_path"], place["file_block_start"], F.monotonically_increasing_id())
        names = [renames.get(c.strip(), c.strip()) for c in df.columns]
        df = df.select(
            *[filled(c).alias(n) for c, n in zip(df.columns, names)], *[c.alias(n) for c, n in zip(where, PLACE)]
        )
        combined = df if combined is None else combined.unionByName(df, allowMissingColumns=True)
    if len(parts) > 1:
        combined = _fill_text(combined)
    if "zip5" not in combined.columns and "primary_postal_code" in combined.columns:
        combined = combined.withColumn("zip5", zip5("primary_postal_code"))
    return combined


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    column_map: Mapping[str, str] | None = None,
    sep: str = ",",
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text with every column a string and trimmed headers; blanks arrive as ''.

    `zip5` is derived from `primary_postal_code` when it is absent. The text is probed once, file by file, unless both
    `encoding` and `multi_line` are given.
    """
    return _read_placed(spark, path, encoding, column_map, sep, multi_line).drop(*PLACE)


def _order(rank: int, place: Sequence[Column]) -> Column:
    """Order of rows over several inputs: rank of the input, then file, block and row."""
    return F.struct(F.lit(rank).alias("file"), *[c.alias(n) for c, n in zip(place, ("path", "block", "row"))])


def _fill_text(df: DataFrame) -> DataFrame:
    return df.fillna("", subset=[n for n, t in df.dtypes if t == "string"])


def read_union(
    spark: SparkSession,
    paths: Sequence[str],
    column_map: Mapping[str, str] | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Several delimited files stacked by name, tagged with `source_file`, blanks for missing columns.

    `_ord` (rank of the input, file path, block, row) keeps the reading order for every later "first", however the
    reader packs files into tasks.
    """
    if not paths:
        raise ValueError("no files given")
    combined = None
    for rank, path in enumerate(paths):
        df = _read_placed(spark, path, encoding, column_map)
        df = df.withColumn("_ord", _order(rank, [F.col(c) for c in PLACE])).drop(*PLACE)
        df = df.withColumn("source_file", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        combined = df if combined is None else combined.unionByName(df, allowMissingColumns=True)
    return _fill_text(combined)


def _list(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, full path) of the sub-directories of a path, by name."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(hadoop_path) if s.isDirectory()]
    return sorted((p.getName(), p.toString()) for p in found if not p.getName().startswith(("_", ".")))


def list_tables(spark: SparkSession, path: str, allow: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """Named tables (sub-directories) of a source; `allow` is matched ignoring case, and falls back to the first."""
    tables = _list(spark, path)
    if allow is None:
        return tables
    wanted = {a.strip().lower() for a in allow}
    return [t for t in tables if t[0].strip().lower() in wanted] or tables[:1]


def read_tables(
    spark: SparkSession, path: str, allow: Sequence[str] | None = None, format: str = "parquet"
) -> DataFrame:
    """Named tables of one source stacked by name and tagged `_source_file`, `_source_tab`, `_ord`.

    Tables outside `allow` are never opened.
    """
    tables = list_tables(spark, path, allow)
    if not tables:
        raise ValueError(f"no tables below {path}")
    source = path.rstrip("/").rsplit("/", 1)[-1]
    combined = None
    for rank, (tab, where) in enumerate(tables):
        if format == "csv":
            df = _read_placed(spark, where, None, None)
            order = _order(rank, [F.col(c) for c in PLACE])
        else:
            df = spark.read.format(format).load(where)
            place = df.metadataColumn("_metadata")
            order = _order(rank, [place["file_path"], place["file_block_start"], F.monotonically_increasing_id()])
        df = df.select(
            *[as_column(c) for c in df.columns if c not in ("_ord", *PLACE)], order.alias("_ord"),
            F.lit(source).alias("_source_file"), F.lit(tab).alias("_source_tab"),
        )
        combined = df if combined is None else combined.unionByName(df, allowMissingColumns=True)
    return _fill_text(combined)


def write_tables(
    outputs: Mapping[str, DataFrame], path: str, skip_empty: bool = True, format: str = "parquet"
) -> list[str]:
    """Write each named table below `path`. Returns the names written.

    Empty tables are left out, but one that is there already is replaced, so no rows of an earlier run are read again.
    """
    written = []
    for name, df in outputs.items():
        if skip_empty and df.isEmpty() and not _is_there(df.sparkSession, f"{path.rstrip('/')}/{name}", format):
            continue
        writer = df.write.mode("overwrite").format(format)
        if format == "csv":
            writer = writer.option("header", True).option("escape", '"')
            writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.save(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


def _is_there(spark: SparkSession, path: str, format: str) -> bool:
    try:
        spark.read.format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


#: Two code points that Unicode keeps out of any text; stands for a genuine replacement character.
_GENUINE = "\ufdd0\ufdd1"


def document_text(value: Column | str) -> Column:
    """Text of a whole file: undecodable bytes and a byte-order mark are dropped, genuine replacement characters stay."""
    raw = as_column(value) if isinstance(value, str) else value
    lost, genuine = F.lit("\ufffd"), F.lit(_GENUINE)
    clean = F.replace(F.make_valid_utf8(F.replace(raw, lost, genuine)), lost, F.lit(""))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(clean, genuine, lost))
    return F.regexp_replace(text, "^\ufeff", "")


def read_documents(spark: SparkSession, path: str, suffixes: Sequence[str] = (".txt",)) -> DataFrame:
    """Whole text files as (file_name, text), the text as `document_text` has it."""
    pattern = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), document_text("value").alias("text"))


def first_existing(df: DataFrame, candidates: Sequence[str], default: str = "") -> Column:
    """The stripped column among the candidates, or a literal when none exists."""
    found = resolve(df, candidates)
    return strip(found) if found else F.lit(default)
