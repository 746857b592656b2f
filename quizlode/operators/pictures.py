"""The picture store: pictures by their content, each kept once, changed by whole steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

_PICTURES = "id string, content binary, length long"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All pictures (id, content, length)."""
    return versions.published(spark, folder, "pictures", _PICTURES).drop("delta")


def put(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Store pictures (name, content) and return (name, id); an id is the content's SHA-256, so what is there stays as it is.

    A row without content has no id and stores nothing.
    """
    named = rows.select("name", F.sha2("content", 256).alias("id"), "content")
    new = named.where("id IS NOT NULL").groupBy("id").agg(F.first("content").alias("content")).join(stored(spark, folder).select("id"), "id", "left_anti")
    versions.publish(spark, folder, {"pictures": new.select("id", "content", F.octet_length("content").cast("long").alias("length"))})
    return named.drop("content")


def get(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """(id, content, length) of ids (id), each once; content is null where the store has none."""
    return ids.select("id").distinct().join(stored(spark, folder), "id", "left")


def delete(spark: SparkSession, folder: str, ids: DataFrame) -> None:
    """Remove the pictures of ids (id); what is left is written anew as one delta."""
    versions.publish(spark, folder, {}, {"pictures": stored(spark, folder).join(ids.select("id").distinct(), "id", "left_anti").select("id", "content", "length")})


def clear(spark: SparkSession, folder: str) -> None:
    versions.publish(spark, folder, {}, {"pictures": spark.createDataFrame([], _PICTURES)})
