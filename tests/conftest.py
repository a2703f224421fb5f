import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from mnemograph.session import get_spark, stage  # noqa: E402
from mnemograph.sources import schema  # noqa: E402

AS_OF = "2024-06-15 12:00:00"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        # Tiny inputs: compiling each plan would take longer than running it.
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """A canonical log from a list of dicts; ``seq`` follows the list order."""
    def make(events, t="2024-06-15T11:00:00+00:00"):
        rows = []
        for i, e in enumerate(events, 1):
            e = {"t": t, "event_id": f"evt_{i}", **e}
            rows.append(tuple(i if c == "seq" else None if c == "ts" else e.get(c)
                              for c in schema.COLUMNS))
        ddl = ", ".join(f"`{n}` {k}" for n, k in schema.COLUMNS.items())
        log = spark.createDataFrame(rows, ddl).withColumn("ts", F.try_to_timestamp("t"))
        return stage(log, "test-log")
    return make


def rows(df, *cols):
    """Sorted tuples of a DataFrame."""
    return sorted(tuple(r) for r in df.select(*cols).collect())
