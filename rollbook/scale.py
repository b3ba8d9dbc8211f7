"""Keeping keyed work even when one key holds a large share of the rows.

Four needs recur in the operators:

* joining rows to a per-key table when some keys are very frequent (`keyed_join`),
* numbering a large set of distinct keys in sorted order without a one-partition window (`global_rank`),
* numbering the rows of each key, or adding them up in order, however many one key has (`segmented`),
* cutting lineage or storing a result where every executor can read it (`checkpointed`, `scratch_path`).

`keyed_join` and `global_rank` look at the size of the sources and keep the plain plan when one task could hold the data.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL_BYTES_CONF = "spark.rollbook.smallBytes"
ROWS_PER_SALT_CONF = "spark.rollbook.rowsPerSalt"

DEFAULT_SMALL_BYTES = 64 << 20
DEFAULT_ROWS_PER_SALT = 2_000_000


def source_bytes(df: DataFrame) -> int:
    """Size of everything a DataFrame reads, from the leaves of its plan; nothing is run or optimised.

    Sources of unknown size count as huge. Catalyst's estimate for the whole plan is of no use here: it multiplies the
    two sides of every outer join.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def is_small(df: DataFrame) -> bool:
    limit = int(df.sparkSession.conf.get(SMALL_BYTES_CONF, str(DEFAULT_SMALL_BYTES)))
    return source_bytes(df) <= limit


def dealt(df: DataFrame) -> DataFrame:
    """Deal a small input that arrives in fewer partitions than there are cores over all of them.

    A small file with one row group is one task, however costly the columns derived from it are. Large inputs come in
    many splits already and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not is_small(df) or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _fits_broadcast(df: DataFrame) -> bool:
    """True when Catalyst itself would broadcast this side."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join that splits hot keys.

    `how` is one of inner, left, left_semi, left_anti. A hot key's left rows are spread over as many salts as its row
    count asks for and its right rows are repeated that often. An inner join spreads a key that is hot on the right as
    well: its rows form a grid, and every left row is repeated for the right salts. Other keys keep one salt. Rows with a
    null key meet nothing; each has a salt of its own, so they do not gather. Output equals the plain join.

    The left side is written once and read from there, so what it is computed from runs once, however many such joins
    follow each other.
    """
    if is_small(left) or _fits_broadcast(right):
        return left.join(right, on, how)
    rows_per_salt = int(left.sparkSession.conf.get(ROWS_PER_SALT_CONF, str(DEFAULT_ROWS_PER_SALT)))
    left = stored(left, "join-left")
    sides = left.select(*on, F.lit(1).alias("__n_l"), F.lit(0).alias("__n_r"))
    if how == "inner":
        right = stored(right, "join-right")
        sides = sides.unionByName(right.select(*on, F.lit(0).alias("__n_l"), F.lit(1).alias("__n_r")))
    # at most one key per rows_per_salt rows of either side, so small enough to broadcast
    counts = sides.where(all_set(on)).groupBy(*on).agg(F.sum("__n_l").alias("__n_l"), F.sum("__n_r").alias("__n_r"))
    hot = counts.where((F.col("__n_l") > rows_per_salt) | (F.col("__n_r") > rows_per_salt))
    salts = [F.greatest(F.ceil(F.col(f"__n_{side}") / F.lit(rows_per_salt)), F.lit(1)).alias(f"__salts_{side}") for side in "lr"]
    hot = stored(hot.select(*on, *salts), "hot-keys")

    def salted(rows: DataFrame, own: str, other: str) -> DataFrame:
        hashable = [f"`{f.name}`" for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        spread = F.xxhash64(*[F.col(c) for c in hashable])
        met = rows.join(F.broadcast(hot), on, "left")
        one = F.lit(1).cast("long")
        place = F.when(all_set(on), F.pmod(spread, F.coalesce(F.col(f"__salts_{own}"), one))).otherwise(spread)
        every = F.explode(F.sequence(one - 1, F.coalesce(F.col(f"__salts_{other}"), one) - 1))
        return met.withColumn(f"__salt_{own}", place).withColumn(f"__salt_{other}", every).drop("__salts_l", "__salts_r")

    both = [*on, "__salt_l", "__salt_r"]
    return salted(left, "l", "r").join(salted(right, "r", "l"), both, how).drop("__salt_l", "__salt_r")


def all_set(columns: list[str]) -> Column:
    """True where none of the columns is null."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"`{c}`").isNotNull()
    return test


def global_rank(keys: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows 1..n in the given order.

    `order` must be a total order. Small inputs use one window. Large inputs are range-partitioned and written as a
    checkpoint, so that both the per-partition row counts and the rows themselves come from the same layout; only the
    counts, one row per partition, meet in one task.
    """
    if is_small(keys):
        return keys.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    placed = checkpointed(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn(
        "__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        placed.join(F.broadcast(starts), "__part")
        .withColumn(name, F.col("__start") + F.col("__row") + 1)
        .drop("__part", "__row", "__at", "__start")
    )


def segmented(df: DataFrame, keys: list[str], order: list, rank: str | None = None, before: Mapping[str, Column] | None = None) -> DataFrame:
    """Number the rows of each key 1..n as `rank`, and sum over the key's earlier rows as the columns of `before`.

    `order` must be a total order within a key; null keys count as one value. The rows are dealt by ranges of (keys, order),
    so a key of any size is spread over as many segments as it needs. Windows run within (segment, key); what the earlier
    segments of a key hold is added from a table with at most one row per segment, which is the bound of the broadcast.
    """
    sums = {"__row": F.lit(1).cast("long"), **(before or {})} if rank else dict(before or {})
    placed = df.withColumns(sums).repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = stored(placed.withColumn("__segment", F.spark_partition_id()), "segments")
    totals = placed.groupBy("__segment", *keys).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__segment", *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.count(F.lit(1)).over(earlier).alias("__earlier"), *[F.sum(c).over(earlier).alias(f"__offset_{c}") for c in sums],
    ).where(F.col("__earlier") > 0)
    within = Window.partitionBy("__segment", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumns({f"__within_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    same = F.col("__segment") == F.col("__other")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    met = counted.join(F.broadcast(offsets.withColumnRenamed("__segment", "__other")), same, "left")
    total = {c: F.coalesce(F.col(f"__offset_{c}"), F.lit(0)) + F.col(f"__within_{c}") for c in sums}
    out = {rank: total.pop("__row") + 1} if rank else {}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *[v.alias(c) for c, v in {**out, **total}.items()])


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="rollbook-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/rollbook/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the plan between phases that each join a table with something computed from itself; without it the plan doubles
    with every phase. Unlike a checkpoint the result has a known size and can be read column by column.
    """
    where = scratch_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def reused(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a plan read: stored once when it is large, recomputed when it is small."""
    return df if is_small(df) else stored(df, name)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
