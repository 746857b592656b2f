"""A log of stages: how long each took and what its rows came to, observed while they are written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import kept


class StageLog:
    """Stages in the order in which they were written; figures are taken in the same pass."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, int, int, dict[str, str]]] = []

    def kept(self, rows: DataFrame, path: str, name: str | None = None, **details: Column) -> DataFrame:
        """``rows`` written to a shared folder and read again, logged by the folder's name or ``name``; details are aggregates."""
        name = name or path.rstrip("/").rsplit("/", 1)[-1]
        seen = Observation(name)
        began = time.monotonic()
        out = kept(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in details.items()]), path)
        found = dict(seen.get)
        self.stages.append((name, round(1000 * (time.monotonic() - began)), found.pop("rows"), {k: str(v) for k, v in found.items()}))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, stage, ms, rows, details)."""
        rows = [(k, *s) for k, s in enumerate(self.stages)]
        return spark.createDataFrame(rows, "place int, stage string, ms long, rows long, details map<string,string>")
