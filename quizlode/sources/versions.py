"""Tables that change by whole steps: folders of deltas and a manifest that is replaced at once.

A step writes its deltas to new folders and then swaps the manifest, which names the deltas of every table, by one
rename. Readers see the tables of the manifest they read; a step that is lost half-way has changed nothing.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "CURRENT"


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The deltas of every table, oldest first; none where nothing was published."""
    jvm, fs = _files(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFEST}")
    if not fs.exists(path):
        return {}
    stream = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def published(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table with the number of the delta that each row is of (column delta)."""
    deltas = manifest(spark, folder).get(name, [])
    parts = [spark.read.schema(schema).parquet(f"{folder}/{d}").withColumn("delta", F.lit(k)) for k, d in enumerate(deltas)]
    if parts:
        return functools.reduce(DataFrame.unionByName, parts)
    none = T.StructType.fromDDL(f"{schema}, delta int")
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none])


def publish(spark: SparkSession, folder: str, added: dict[str, DataFrame], whole: dict[str, DataFrame] | None = None) -> None:
    """One step: deltas added to tables, and tables replaced as a whole; all of it is seen at once.

    Whoever publishes is alone in doing so. Deltas that are replaced are removed after the swap.
    """
    before = manifest(spark, folder)
    after = {name: list(deltas) for name, deltas in before.items()}
    for name, rows in {**added, **(whole or {})}.items():
        delta = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{folder}/{delta}")
        after[name] = [delta] if whole and name in whole else [*after.get(name, []), delta]
    jvm, fs = _files(spark, folder)
    path = lambda name: fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    fresh = path(f"{_MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps(after).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, path(_MANIFEST), options)
    for name in set().union(*before.values()) - set().union(*after.values()):
        fs.delete(path(name), True)
