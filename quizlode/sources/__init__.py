"""Where rows come from: tables, page files and bank files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores by columns: a small file is read by one task, however long its rows take."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def balanced(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a table as they are read, or dealt by columns where a few tasks would read most of them. Rows are counted."""
    n = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    return spread(rows, *by) if (n.most or 0) * rows.sparkSession.sparkContext.defaultParallelism > 3 * (n.rows or 0) else rows


#: Rows that a task takes of what ``dealt`` deals.
ROWS_OF_TASK = 500_000


def dealt(rows: DataFrame, *by: str, of_task: int | None = None) -> DataFrame:
    """Rows dealt by columns to as many tasks as their number asks for, so that what a task holds doesn't grow with the table.

    Few rows stay as they are. Rows are counted, so they should be those of a table.
    """
    n = tasks_for(rows, of_task)
    return rows.repartition(n, *by) if n else rows


def tasks_for(rows: DataFrame, of_task: int | None = None) -> int | None:
    """The tasks that so many rows ask for; none where they are few."""
    spark, of_task = rows.sparkSession, of_task or ROWS_OF_TASK
    n = rows.count()
    if n <= of_task * spark.sparkContext.defaultParallelism:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // of_task))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a temporary one where all run in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="quizlode-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows written to a shared folder and read again: what uses them twice, or after a loss, doesn't work them out again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove folders whose tables have been consumed."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
