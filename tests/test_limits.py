"""Nothing is dropped by default."""

import time

import pytest
from pyspark.sql import functions as F

from pagestrata.constants import DEFAULT_LIMITS
from pagestrata.errors import AuditError
from pagestrata.operators import inventory
from pagestrata.operators.skew import hot_keys
from pagestrata.session import with_deadlines


def test_imports_count_excluded_pages_as_fetched(spark):
    rows = spark.createDataFrame([("a", "rendered", True, False), ("a", "excluded", False, False)], "site string, status string, selected boolean, partial_coverage boolean")
    assert inventory.inventory_summary(rows).first()["fetched"] == 2
    assert inventory.inventory_summary(rows, crawled=True).first()["fetched"] == 1


def test_limits_can_be_raised():
    more = DEFAULT_LIMITS.raised(discovered=1_000_000, page_characters=10_000_000)
    assert (more.discovered, more.page_characters, more.fetched) == (1_000_000, 10_000_000, 250)
    assert more.lowered(discovered=900_000).discovered == 900_000
    with pytest.raises(AuditError):
        DEFAULT_LIMITS.lowered(discovered=1_000_000)
    with pytest.raises(AuditError):
        DEFAULT_LIMITS.raised(fetched=0)


def test_all_hot_keys_are_split(spark):
    counts = spark.range(3000).select(F.col("id").alias("k"), F.lit(50).alias("n"))
    assert hot_keys(counts, ["k"], "n", 20).where("_parts = 3").count() == 3000


def test_slow_sources_are_waited_for(spark):
    def slow():
        time.sleep(2)
        return spark.range(4)

    assert with_deadlines(spark, {"slow": slow})["slow"].count() == 4
