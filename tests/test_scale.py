import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from rollbook import scale


@pytest.fixture
def skewed(spark):
    """Ninety rows, a third of them under one key, some under none."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 10 == 1 else f"k{i % 17}") for i in range(90)]
    return spark.createDataFrame(rows, "_ord long, key string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join_equals_the_plain_join(spark, spread, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k5", 4), ("zz", 5), (None, 6)], "key string, v int")
    got, want = scale.keyed_join(skewed, right, ["key"], how), skewed.join(right, ["key"], how)
    assert got.columns == want.columns
    assert rows_of(got, *got.columns) == rows_of(want, *want.columns)


def test_keyed_join_splits_the_hot_key(spark, spread, skewed):
    right = skewed.groupBy("key").agg(F.count("*").alias("n"))
    joined = scale.keyed_join(skewed, right, ["key"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_small_sides_keep_the_plain_join(spark, tmp_path, skewed):
    skewed.write.parquet(str(tmp_path / "t"))
    left = spark.read.parquet(str(tmp_path / "t"))
    assert scale.is_small(left)
    plan = scale.keyed_join(left, left.groupBy("key").count(), ["key"])._jdf.queryExecution().toString()
    assert "__salt" not in plan


def test_unknown_sizes_count_as_large(spark):
    assert not scale.is_small(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int"))


@pytest.mark.parametrize("large", [False, True])
def test_global_rank(spark, large, request):
    if large:
        request.getfixturevalue("spread")
    keys = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = scale.global_rank(keys, [F.col("k")], "r").orderBy("k").collect()
    assert [r["r"] for r in got] == list(range(1, 1001))


def test_shared_folder_comes_from_the_session(spark):
    assert scale.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_many_hot_keys_and_blank_keys_join_as_a_plain_join(spark, spread):
    from pyspark.sql import functions as F

    from rollbook.scale import keyed_join

    left = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 >= 3, F.col("id") % 3000).alias("k"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got, want = keyed_join(left, right, ["k"], how), left.join(right, ["k"], how)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_segmented_numbers_and_sums_equal_a_window(spark, skewed):
    rows = skewed.withColumn("v", F.col("_ord") * 3)
    found = scale.segmented(rows, ["key"], [F.desc("_ord")], "n", {"earlier": F.col("v")})
    want = []
    for key in {r.key for r in rows.collect()}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows.collect() if r.key == key), key=lambda r: -r._ord), 1):
            want.append((r._ord, key, r.v, n, total))
            total += r.v
    assert found.columns == ["_ord", "key", "v", "n", "earlier"]
    assert rows_of(found, *found.columns) == sorted(want, key=repr)


def test_segmented_spreads_one_key(spark):
    rows = spark.range(20_000).select(F.col("id").alias("_ord"), F.lit(None).cast("string").alias("key"))
    found = scale.segmented(rows, ["key"], [F.asc("_ord")], "n")
    assert found.where(F.col("n") != F.col("_ord") + 1).count() == 0
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__segment" in text and scale.segmented(rows.limit(0), ["key"], [F.asc("_ord")], "n").count() == 0


def test_keys_hot_on_either_side_form_a_grid(spark, spread, tmp_path):
    """Three thousand hot keys left, three thousand right, some on both, blank keys on both."""
    made = spark.range(24_000).select(F.col("id"), F.when(F.col("id") % 50 > 0, F.col("id") % 3000).alias("k"))
    made.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = spark.range(21_000).select((F.col("id") * 7).alias("v"), F.when(F.col("id") % 70 > 0, 1500 + F.col("id") % 3000).alias("k"))
    got, want = scale.keyed_join(left, right, ["k"], "inner"), left.join(right, ["k"], "inner")
    assert got.columns == want.columns
    total = [F.count(F.lit(1)), F.sum(F.xxhash64(*want.columns) % 1_000_003), F.count_distinct(*want.columns)]
    assert got.agg(*total).first() == want.agg(*total).first()
    plan = got._jdf.queryExecution().toString()
    assert "__salt_r" in plan and f"{tmp_path}/left" not in plan  # the left side was read once, to be stored
