"""An extension beyond batch use: pages that arrive as files are upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

PAGES = "document_id long, page_number int, text string, version long"


def stream_pages(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append page files of ``folder`` (JSON lines) to the Parquet log ``target``; every run takes what is new and stops.

    A replayed batch writes its own folder anew, so pages come in exactly once by key; latest_pages() reads the result.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    return spark.readStream.schema(PAGES).json(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_pages(spark: SparkSession, target: str) -> DataFrame:
    """The latest version of every page in the log."""
    log = spark.read.parquet(target)
    best = F.max_by(F.struct("text", "version"), F.struct("version", "batch"))
    return log.groupBy("document_id", "page_number").agg(best.alias("p")).select("document_id", "page_number", "p.*")
