import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tabreg-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tabreg.sources.shipping import ship_package
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture
def make(spark):
    """DataFrame from a pandas frame, NaN as NULL, in a chosen number of partitions."""
    def build(pdf, parts=3):
        rows = [tuple(None if v != v else (v.item() if hasattr(v, "item") else v) for v in r)
                for r in pdf.itertuples(index=False, name=None)]
        kinds = {"f": "double", "i": "long", "O": "string", "b": "boolean", "M": "timestamp_ntz"}
        schema = ", ".join(f"`{c}` {kinds[t.kind]}" for c, t in pdf.dtypes.items())
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
