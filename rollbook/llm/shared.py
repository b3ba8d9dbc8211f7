"""Helpers of the training-data operators: shared folders, stored tables, bounded Arrow slices, words."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import sys
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local master without it a new one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = "file://" + tempfile.mkdtemp(prefix="training-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    where = new_folder(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


#: Files that a list of ids is dealt to.
ID_FILES = 512


def only(rows: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id (long) is among `ids`, a table of one column.

    The rows, with texts as long as they may be, stay where they are: the ids go to files in the shared folder, those of 2^18
    consecutive numbers to the same one, and a task reads the files that its rows fall in.
    """
    folder = new_folder(rows.sparkSession, "ids")
    high = [F.shiftright(F.col(ids.columns[0]), by) for by in (18, 33)]
    file = F.pmod(high[0].bitwiseXOR(high[1]), F.lit(ID_FILES)).cast("int")
    placed = ids.select(F.col(ids.columns[0]).alias("id"), file.alias("file")).filter("id is not null")
    placed.repartition("file").write.partitionBy("file").parquet(folder)
    read: dict[int, np.ndarray] = {}

    def listed(file: int) -> np.ndarray:
        files, path = file_system(f"{folder}/file={file}")
        found = [np.zeros(0, np.int64)]
        for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as data:
                    found.append(pq.read_table(data, columns=["id"])["id"].to_numpy())
        return np.sort(np.concatenate(found))

    @F.arrow_udf("boolean")
    def among(column: pa.Array) -> pa.Array:
        numbers = pc.fill_null(column, 0).to_numpy()
        file = ((numbers >> 18) ^ (numbers >> 33)) % ID_FILES
        found = np.zeros(len(numbers), bool)
        for one in np.unique(file).tolist():
            if one not in read:
                read[one] = listed(one)
            places = np.flatnonzero(file == one)
            after = np.searchsorted(read[one], numbers[places], "right")
            found[places] = after > np.searchsorted(read[one], numbers[places], "left")
        return pc.and_(pa.array(found, pa.bool_()), column.is_valid())

    return rows.filter(among(F.col(id_column)))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, for tasks that write or read binary files."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_or_empty(texts: pa.Array) -> pa.Array:
    """A plain string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (from, until) of at most `limit` bytes of text, at least one row each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        LAST_USE[0] = time.monotonic()
        until = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, until
        at, before = until, int(ends[until - 1])
    release()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: word numbers, offsets of the texts in them, and the distinct words."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    marks = full.to_numpy(zero_copy_only=False)
    until = np.concatenate([[0], np.cumsum(marks)])
    starts = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), until[starts], coded.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of `values`; empty runs give 0."""
    total = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        total[full] = np.add.reduceat(np.asarray(values, np.float64), offsets[full])
    return total


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo `folds`; a null id is in fold 0."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As `words_of`, for lower-cased runs of letters."""
    return words_of(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))


def hashed_share(column: str | Column, share: Column) -> Column:
    """True for a share (0 to 1) of the rows, fixed by the column's hash."""
    return F.pmod(F.xxhash64(F.lit("share"), F.col(column) if isinstance(column, str) else column), F.lit(1 << 30)) < share * (1 << 30)


MAGIC = b"ARRAYS01"


def write_file(uri: str, parts: list[bytes | memoryview]) -> None:
    """Write a file under a name of its own and move it into place, so that a repeated task leaves one whole file."""
    files, path = file_system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    files.move(draft, path)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Several arrays as one file: a header in JSON, then each array at a multiple of 64 bytes."""
    spec, at, parts = {}, 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array)
        spec[name] = (data.dtype.str, data.shape, at)
        fill = -data.nbytes % 64
        parts += [data.tobytes(), bytes(fill)]
        at += data.nbytes + fill
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 16) % 64)
    write_file(uri, [MAGIC, len(head).to_bytes(8, "little"), head, *parts])


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read once."""
    files, path = file_system(uri)
    if isinstance(files, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with files.open_input_stream(path) as file:
            data = np.frombuffer(file.read(), np.uint8)
    if bytes(data[:8]) != MAGIC:
        raise ValueError(f"{uri} is no array file")
    size = int.from_bytes(bytes(data[8:16]), "little")
    out = {}
    for name, (kind, shape, at) in json.loads(bytes(data[16 : 16 + size])).items():
        count = int(np.prod(shape))
        begin = 16 + size + at
        out[name] = data[begin : begin + count * np.dtype(kind).itemsize].view(kind).reshape(shape)
    return out


def release() -> None:
    """Give freed memory back, as a worker waits between tasks beside its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy() -> None:
    """As `release`, after a model was fitted: unreachable objects go first."""
    gc.collect()
    release()


#: What the present operator keeps from task to task in a worker, when a worker last worked, and which process watches that.
KEPT: dict[tuple[str, str], object] = {}
LAST_USE = [0.0]
WATCHED = [0]
#: Seconds after which a worker without work lets go what it keeps.
IDLE_SECONDS = 8


def kept(operator: str, key: str, make: Callable[[], object]) -> object:
    """An object that a worker keeps between tasks; what another operator kept is let go, as is everything in a worker that has
    had no work for a while, so a job of many stages needs no more memory than its largest one."""
    LAST_USE[0] = time.monotonic()
    found = KEPT.get((operator, key))
    if found is None:
        if any(other != operator for other, _ in list(KEPT)):
            KEPT.clear()
            tidy()
        found = KEPT[operator, key] = make()
    if WATCHED[0] != os.getpid():
        WATCHED[0] = os.getpid()
        threading.Thread(target=_let_go, daemon=True).start()
    return found


def _let_go() -> None:
    while True:
        time.sleep(2)
        if KEPT and time.monotonic() - LAST_USE[0] > IDLE_SECONDS:
            KEPT.clear()
            tidy()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Fewer rows per Arrow batch for the jobs run inside; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
