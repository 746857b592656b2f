"""Saved banks: JSON of questions in the flat or the structured shape, read as structured ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleanup
from ..operators import records
from ..operators.bank import answer_keys

#: Fields of either shape. What is an object in one of them is read as its JSON text.
_SAVED = (
    "id string, number string, questionNumber string, question string, options string, correctAnswer string, answerText string, answer string, explanation string, pageNumber int, "
    "source string, confidence string, status string, verificationStatus string, category string, tags array<string>, imageId string"
)
_OPTIONS, _ANSWER = "array<struct<key:string,text:string>>", "struct<key:string,text:string>"
_CONFIDENCE = "struct<question:double,options:double,answer:double,overall:double,level:string>"


def _flat_answer(options: Column) -> Column:
    """The flat shape's answer: its letters, and its text or that of the options they name; null without either."""
    key = F.coalesce("correctAnswer", F.lit(""))
    named = F.filter(F.transform(answer_keys(key), lambda k: F.get(F.filter(options, lambda o: o["key"] == k), F.lit(0))["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    said = F.coalesce(F.nullif("answerText", F.lit("")), F.array_join(named, "; "), F.lit(""))
    return F.when((key != "") | (said != ""), F.struct(key.alias("key"), said.alias("text")))


def upgraded(saved: DataFrame) -> DataFrame:
    """Saved rows (of _SAVED) as structured questions, without what scores left in their texts.

    A row whose options are a list is structured already; a flat one gets its options by letter, an answer with its text,
    confidence from what there is of it, and a status from its level. Rows without an id are dropped.
    """
    structured = F.startswith(F.trim("options"), F.lit("["))
    listed = F.from_json("options", _OPTIONS)
    by_letter = F.array_sort(F.transform(F.map_entries(F.from_json("options", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"))))
    options = F.coalesce(F.when(structured, listed).otherwise(by_letter), F.array().cast(_OPTIONS))
    rows = saved.where("id IS NOT NULL").withColumn("_structured", F.coalesce(structured, F.lit(False))).withColumn("_options", options)
    stem = F.when(F.col("_structured"), F.get_json_object("question", "$.text")).otherwise(F.col("question"))
    answer = F.when(F.col("_structured"), F.from_json("answer", _ANSWER)).otherwise(_flat_answer(F.col("_options")))
    rows = rows.withColumn("_stem", F.coalesce(stem, F.lit(""))).withColumn("_answer", answer)
    own = records.structured(F.size("_options"), F.length("_stem"), F.col("_answer").isNotNull())
    level = F.when(F.col("_structured"), F.get_json_object("confidence", "$.level")).otherwise(F.col("confidence"))
    told = F.from_json("confidence", _CONFIDENCE)
    confidence = F.when(F.col("_structured"), told).otherwise(F.struct(own["question"].alias("question"), own["options"].alias("options"), own["answer"].alias("answer"), own["overall"].alias("overall"), level.alias("level")))
    number = F.coalesce(F.when(F.col("_structured"), F.col("questionNumber")).otherwise(F.regexp_extract("number", r"^\s*(\d+)", 1)).try_cast("int"), F.lit(1))
    status = F.when(F.col("_structured"), F.col("status")).otherwise(F.coalesce("verificationStatus", F.when(level == "high", "verified").otherwise("pending")))
    clean = cleanup.strip_score_noise
    return rows.select(
        "id", number.alias("number"), clean(F.col("_stem")).alias("question"),
        F.transform("_options", lambda o: F.struct(o["key"].alias("key"), clean(o["text"]).alias("text"))).alias("options"),
        F.when(F.col("_answer").isNotNull(), F.struct(F.col("_answer")["key"].alias("key"), clean(F.col("_answer")["text"]).alias("text"))).alias("answer"),
        "explanation", confidence.alias("confidence"), status.alias("status"), F.coalesce("category", F.lit("General")).alias("category"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.get_json_object("source", "$.documentId"), F.lit("doc-default")).alias("document_id"),
        F.coalesce(F.get_json_object("source", "$.pageNumber").try_cast("int"), "pageNumber", F.lit(1)).alias("page"), F.col("imageId").alias("image_id"),
    )


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The questions of saved banks: files that are one JSON list each, or ``lines`` of one question each."""
    return upgraded(spark.read.schema(_SAVED).option("multiLine", not lines).json(path))
