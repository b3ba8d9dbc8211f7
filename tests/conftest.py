import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        # tables of a few rows: compiling whole stages costs far more than it saves (tools/check.py compiles them)
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def spread(spark):
    """The plans meant for large data: nothing counts as small, keys with more than two rows are split."""
    settings = {
        "spark.rollbook.smallBytes": "0",
        "spark.rollbook.rowsPerSalt": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture
def table(spark):
    """A table of strings with `_ord` from tuples."""

    def make(columns: str, *rows):
        names = columns.split()
        data = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, ["_ord", *names] if rows else "_ord long, " + ", ".join(f"{n} string" for n in names))

    return make


def rows_of(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
