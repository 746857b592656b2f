"""Queries whose rows take long are dealt to all cores, however small the file is."""

import re

import pytest
from pyspark.sql import functions as F

from quizlode import sources
from quizlode.functions import text
from quizlode.operators import review
from quizlode.plans import queries


@pytest.mark.parametrize("name", ["repaired_labels", "cleanup_scalars"])
def test_rows_are_dealt_to_all_cores(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_letters_are_counted_once(spark):
    """Three counts are three passes over a text, though every share is of all of them."""
    assert str(text.languages(F.col("text"))).count("regexp_replace(") == 3


def shares(found):
    """Rows of a result's partitions."""
    return [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]


def test_a_task_takes_no_more_of_a_larger_table(spark, monkeypatch):
    """Partitions follow the rows of a table, not a fixed number of shuffle partitions."""
    monkeypatch.setattr(sources, "ROWS_OF_TASK", 300)
    plain = queries.QUERIES["note_owners"]
    found = plain(spark, "/root/testdata/sf0.001")
    assert len(shares(found)) >= 15 and max(shares(found)) < 700
    wanted = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(sources, "ROWS_OF_TASK", 10**6)
    assert sorted(map(tuple, plain(spark, "/root/testdata/sf0.001").collect())) == wanted


def test_a_task_takes_no_more_of_more_pages(spark, monkeypatch):
    monkeypatch.setattr(review, "PAGES_OF_TASK", 50)
    found = queries.QUERIES["review_rows"](spark, "/root/testdata/sf0.001")
    assert len(shares(found)) >= 20 and max(shares(found)) < 800
    monkeypatch.setattr(review, "PAGES_OF_TASK", 10**6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, queries.QUERIES["review_rows"](spark, "/root/testdata/sf0.001").collect()))


def test_instances_are_dealt_once_to_be_detached(spark, monkeypatch):
    monkeypatch.setattr(sources, "ROWS_OF_TASK", 300)
    found = queries.QUERIES["detached_documents"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(document_id#\d+L?, (\d+)\)", plan)
    assert dealt and all(int(n) >= 20 for n in dealt) and "LeftSemi" not in plan
    monkeypatch.setattr(sources, "ROWS_OF_TASK", 10**6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, queries.QUERIES["detached_documents"](spark, "/root/testdata/sf0.001").collect()))
