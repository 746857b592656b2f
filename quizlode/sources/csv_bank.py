"""Bank files: CSV with a header and a report on each row, and JSON banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

#: Header names that stand for each column.
ALIASES = {
    "question": ("question", "question_text", "stem"),
    "option_a": ("option_a", "a", "option a"),
    "option_b": ("option_b", "b", "option b"),
    "option_c": ("option_c", "c", "option c"),
    "option_d": ("option_d", "d", "option d"),
    "answer": ("answer", "correct_answer", "correct", "key"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a quoted CSV with a header, all as text, with the row's position as id."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    names = {c.replace("﻿", "").strip().strip('"').lower(): c for c in raw.columns}
    pick = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in ALIASES.items()}
    rows = raw.select(*[(F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(k) for k, c in pick.items()])
    return rows.withColumn("id", F.monotonically_increasing_id())


def import_report(rows: DataFrame) -> DataFrame:
    """Rows (id, question, option_a .. option_d, answer) with a reason where invalid, and whether they repeat a question.

    A row needs a question, two options and an answer among A to E or the Bengali letters; repeats are marked, not dropped.
    """
    filled = F.size(F.filter(F.array("option_a", "option_b", "option_c", "option_d"), lambda o: F.coalesce(o, F.lit("")) != ""))
    key: Column = text.option_key(F.upper(F.coalesce("answer", F.lit(""))))
    reason = (
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "missing question")
        .when(filled < 2, "fewer than two options")
        .when(F.coalesce(F.trim("answer"), F.lit("")) == "", "missing answer")
        .when(~key.isin(*"ABCDE"), "invalid answer")
    )
    rows = rows.withColumn("reason", reason).withColumn("_key", text.comparison_key(F.col("question")))
    rank = F.row_number().over(W.partitionBy("_key", F.col("reason").isNull()).orderBy("id"))
    return rows.withColumn("is_duplicate", F.col("reason").isNull() & (rank > 1)).drop("_key")


def read_json_bank(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON bank: a list of them, or an object that holds one."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("questions").alias("q")).select("q.*") if "questions" in raw.columns else raw
