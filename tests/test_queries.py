"""Every registered query against its SQL on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from tamis.queries.registry import dealt_anew


@pytest.fixture(scope="module")
def duck(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, sf, name):
    problem, _ = check.compare(spark, duck, name, sf)
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["x", "series", "y"]


@pytest.mark.parametrize("name", ["q_content_hash", "q_sample_random"])
def test_tables_are_not_dealt_into_a_fixed_number_of_partitions(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
    assert not re.search(r"Repartition \d+, true", plan)


def test_dealt_anew_bounds_a_task_by_size(spark):
    rows = spark.range(0, 60_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("body"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        sizes = [r.n for r in dealt_anew(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.xxhash64("id", "body"))).collect()]
        same = dealt_anew(rows).agg(F.count("*"), F.sum(F.xxhash64("id", "body").cast("decimal(38,0)"))).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(sizes) == 60_000 and len(sizes) > 7 and max(sizes) < sum(sizes) / 7
    assert same == rows.agg(F.count("*"), F.sum(F.xxhash64("id", "body").cast("decimal(38,0)"))).first()
