"""Projections of the star-schema tables that stand for exam data, so that every operator runs at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced, table


def exam_pages(spark: SparkSession, folder: str, style: str = "inline") -> DataFrame:
    """One exam per region, a question per nation: (document_id, page_number, text).

    style: ``inline`` answers, an answer ``key`` at the end, ``bengali`` numerals and letters, or ``none``.
    """
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    names = region.groupBy().agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = rows.withColumn("r", names.scalar())
    number = F.row_number().over(_by_region())
    rows = rows.withColumn("number", number)
    letters = "কখগঘঙ" if style == "bengali" else "ABCDE"
    own = F.substr(F.lit(letters), F.col("r_regionkey") + 1, F.lit(1))
    lines = F.transform("r", lambda x, i: F.concat(F.substr(F.lit(letters), i + 1, F.lit(1)), F.lit(". "), x["r_name"]))
    shown = F.translate(F.col("number").cast("string"), "0123456789", "০১২৩৪৫৬৭৮৯") if style == "bengali" else F.col("number").cast("string")
    head = F.concat(shown, F.lit("। " if style == "bengali" else ". "), F.lit("Region of "), F.col("n_name"), F.lit("?"))
    tail = {"inline": F.concat(F.lit("Answer: "), own), "bengali": F.concat(F.lit("উত্তর: "), own)}.get(style)
    body = F.concat_ws("\n", head, F.array_join(lines, "\n"), *([tail] if tail is not None else []))
    rows = rows.withColumn("body", body).withColumn("entry", F.concat(F.col("number").cast("string"), F.lit("-"), own))
    parts = rows.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("number", "body", "entry"))).alias("q"))
    text = F.array_join(F.transform("q", lambda x: x["body"]), "\n")
    if style == "key":
        text = F.concat(text, F.lit("\nAnswer Key:\n"), F.array_join(F.transform("q", lambda x: x["entry"]), ", "))
    return parts.select(F.col("r_regionkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))


def _by_region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents: (document, page, pos, line); a source is the document, a document its page."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """Question instances of lineitem: scores from return flags, picked options from suppliers, questions from parts."""
    items = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "FULL_SCORE").when(F.col("l_returnflag") == "N", "PARTIAL_SCORE").otherwise("ZERO_SCORE")
    return items.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("sequence"),
        F.col("l_partkey").alias("canonical_id"),
        kind.alias("score_kind"),
        (F.col("l_suppkey") % 4).cast("int").alias("picked"),
        (F.col("l_linestatus") == "O").alias("multi"),
        F.col("l_quantity").alias("earned"),
    )


def bank(spark: SparkSession, folder: str) -> DataFrame:
    """A bank of questions from parts: id, question, options, answer, tags and bookkeeping columns."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("document"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), F.col("p_size") % 4 + 1)).alias("answer"),
        F.when(F.col("p_size") % 5 == 0, "verified").when(F.col("p_size") % 5 == 1, "rejected").when(F.col("p_size") % 5 == 2, "review").otherwise("pending").alias("status"),
        F.when(F.col("p_size") > 35, "high").when(F.col("p_size") > 15, "medium").otherwise("needs-review").alias("confidence"),
        F.col("p_retailprice").alias("score"),
        F.col("p_size").alias("size"),
    )


def stems(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of documents as question stems, options from language and source."""
    from ..functions import text

    docs = balanced(table(spark, folder, "documents"), "doc_id")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("stem"), text.dedupe_key(F.col("text")).alias("key"), F.array("lang", "source").alias("options"), F.lit("SINGLE_CHOICE").alias("type"))


def positioned_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The exams of exam_pages as positioned items (document_id, page, items), each with a feedback line and a footer."""
    plain = exam_pages(spark, folder, "none")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("document_id"), F.concat(F.lit("The correct answer is: "), F.col("r_name")).alias("told"))
    rows = plain.join(region, "document_id")
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda x: F.when(x.startswith("E. "), F.array(x, F.col("told"))).otherwise(F.array(x))))
    item = lambda x, y: F.struct(x.alias("str"), F.lit(160.0).alias("x"), y.cast("double").alias("y"), (F.length(x) * 5.2).cast("double").alias("w"), F.lit(11.0).alias("h"))
    items = F.transform(F.concat(lines, F.array(F.lit("https://example.org/review"))), lambda x, i: item(x, 40 + 16 * i))
    return rows.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").alias("page"), items.alias("items"))


def _one_of(x, *values: str):
    """The value at x modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (x % len(values) + 1).cast("int"))


#: Statuses that the projections below give out in turn.
ANSWERS, EXTRACTIONS = ("CONFLICT", "NEEDS_REVIEW", "UNRESOLVED", "CONFIRMED_BY_SCORE"), ("PARSED", "NEEDS_REVIEW", "FAILED")


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of orders: document_id, filename, subject, stage, created_at, and a nested column."""
    rows = table(spark, folder, "orders")
    return rows.select(
        F.col("o_orderkey").alias("document_id"), F.concat(F.lit("file"), F.col("o_custkey").cast("string")).alias("filename"), F.col("o_orderpriority").alias("subject"),
        F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").alias("created_at"), F.struct("o_totalprice").alias("profile"),
    )


def canonical_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical questions of parts: id, stem, subject, question_type, statuses, in_bank, confidence, updated_at, keys."""
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("stem"), F.col("p_brand").alias("subject"), F.col("p_type").alias("question_type"), _one_of(size, *ANSWERS).alias("answer_status"),
        F.lit("PENDING").alias("review_status"), (size % 2 == 0).alias("in_bank"), (size / 50).alias("confidence"), F.col("p_retailprice").alias("updated_at"),
        F.array(_one_of(size, "A", "B", "C")).alias("keys"), F.split(F.lit("A,B,C,D"), ",").alias("valid_keys"),
    )


def instance_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Instances of lineitem: id, document_id, attempt_id, sequence, canonical_id, statuses, votes."""
    rows = table(spark, folder, "lineitem")
    order = F.col("l_orderkey")
    return rows.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), order.alias("document_id"), (F.col("l_suppkey") % 3).alias("attempt_id"),
        F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("canonical_id"), _one_of(F.col("l_quantity").cast("int"), *EXTRACTIONS).alias("extraction_status"),
        _one_of(F.col("l_suppkey"), *ANSWERS).alias("answer_status"), F.col("l_quantity").cast("long").alias("votes"),
    )


def task_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Review tasks of events: task_id, canonical_id, document_id, kind, status."""
    rows = table(spark, folder, "events")
    status = F.when(F.col("value") > 50, "RESOLVED").otherwise("OPEN")
    kind = F.when(F.col("event_type") == "error", "POSSIBLE_DUPLICATE").otherwise(F.upper("event_type"))
    return rows.select(F.col("event_id").alias("task_id"), (F.col("event_id") % 400).alias("canonical_id"), F.col("user_id").alias("document_id"), kind.alias("kind"), status.alias("status"))


def flat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Flat questions of parts: id, number, question, options map, answer, status, confidence, category, image_id, tags, text."""
    size = F.col("p_size")
    answer = F.when(size % 3 != 0, _one_of(size, "A", "B", "Z"))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("number"), F.col("p_name").alias("question"), F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type")).alias("options"),
        answer.alias("answer"), F.when(answer.isNull(), "missing_answer").when(size % 5 == 1, "needs_review").otherwise("answered").alias("status"),
        F.when(size > 35, "high").when(size > 15, "medium").otherwise("needs-review").alias("confidence"), F.col("p_brand").alias("category"),
        F.when(size % 7 == 0, F.concat(F.lit("img"), size.cast("string"))).alias("image_id"), F.when(size % 11 == 0, F.array(F.lit("figure"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(size % 4 == 0, F.lit("typed")).alias("answer_text"),
    )
