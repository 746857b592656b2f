"""The store of documents, pages, instances and canonical questions: lists, joins, and changes as keyed rewrites.

A change takes the tables it touches and returns what they hold afterwards; writing them back is the caller's. Joins are
on ids, lists carry a tie-breaker, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import tasks_for
from .bank import like

#: Rows of a page of canonical questions and of a list of documents, and of a page of the plain question list.
MOST_CANONICALS, MOST_DOCUMENTS, MOST_PAGE, USUAL_PAGE = 200, 200, 100, 50


# --- lists -----------------------------------------------------------------------------------------------------------


def canonicals(
    rows: DataFrame, subject: str | None = None, answer_status: str | None = None, question_type: str | None = None, in_bank: bool | None = None, query: str | None = None
) -> DataFrame:
    """Canonical questions that equal what is given and hold the query in their stem, case-blind, % and _ literally."""
    for column, value in (("subject", subject), ("answer_status", answer_status), ("question_type", question_type), ("in_bank", in_bank)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.coalesce(like(F.col("stem"), query), F.lit(False))) if query else rows


def canonical_page(rows: DataFrame, limit: int = USUAL_PAGE, offset: int = 0) -> DataFrame:
    """The latest updated canonical questions (id, updated_at): at most 200 after ``offset`` of them."""
    return rows.orderBy(F.desc("updated_at"), "id").offset(max(0, offset)).limit(min(limit, MOST_CANONICALS))


def questions(bank: DataFrame, query: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    """Bank rows (question, options map, answer, status, category): the query in the question, an option or the answer."""
    if query:
        hit = like(F.col("question"), query) | like(F.col("answer"), query) | F.exists(F.map_values("options"), lambda o: like(o, query))
        bank = bank.where(F.coalesce(hit, F.lit(False)))
    for column, value in (("status", status), ("category", category)):
        if value not in (None, "all"):
            bank = bank.where(F.col(column) == value)
    return bank


def question_page(rows: DataFrame, page: int = 1, limit: int = USUAL_PAGE) -> DataFrame:
    """One page of 1 to 100 rows (id), in order of id."""
    limit = min(MOST_PAGE, max(1, limit))
    return rows.orderBy("id").offset((max(1, page) - 1) * limit).limit(limit)


def documents(rows: DataFrame) -> DataFrame:
    """The newest documents, at most 200, without their nested columns."""
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("struct", "array", "map")]
    return rows.select(*plain).orderBy(F.desc("created_at"), "document_id").limit(MOST_DOCUMENTS)


def by_id(rows: DataFrame, value, column: str = "id") -> DataFrame:
    """The row of an id, or none."""
    return rows.where(F.col(column) == value).limit(1)


def with_documents(instances: DataFrame, documents: DataFrame) -> DataFrame:
    """Instances with the filename and subject of their document, null where it is gone."""
    return instances.join(documents.select("document_id", "filename", "subject"), "document_id", "left")


def members(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """The instances of the canonical questions named in ids (canonical_id)."""
    return instances.join(ids.select("canonical_id").distinct(), "canonical_id", "left_semi")


def member_places(canonicals: DataFrame, instances: DataFrame) -> DataFrame:
    """(canonical_id, place, id): the members of each canonical question in order; one row without a member for those that have none."""
    place = F.row_number().over(W.partitionBy("canonical_id").orderBy("document_id", "sequence", "id"))
    ranked = instances.where("canonical_id IS NOT NULL").select("canonical_id", place.alias("place"), "id")
    return canonicals.select(F.col("id").alias("canonical_id")).join(ranked, "canonical_id", "left")


def pages_received(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"))


def canonical_ids(instances: DataFrame) -> DataFrame:
    """(document_id, canonical_id): the distinct canonical questions of each document."""
    return instances.where("canonical_id IS NOT NULL").select("document_id", "canonical_id").distinct()


def open_tasks(tasks: DataFrame) -> DataFrame:
    """One row: how many tasks are open."""
    return tasks.where("status = 'OPEN'").agg(F.count("*").alias("open"))


# --- documents -------------------------------------------------------------------------------------------------------


def create_documents(documents: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Documents with the incoming ones (document_id, filename, subject) that are new, at the stage UPLOADED."""
    new = incoming.join(documents.select("document_id"), "document_id", "left_anti").dropDuplicates(["document_id"])
    return documents.unionByName(new.withColumn("stage", F.lit("UPLOADED")).withColumn("created_at", now), allowMissingColumns=True)


def set_stage(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with the stage of changes (document_id, stage) where there is one."""
    return documents.join(changes.select("document_id", F.col("stage").alias("_stage")), "document_id", "left").withColumn("stage", F.coalesce("_stage", "stage")).drop("_stage")


def attach_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with the path of files (document_id, path); an earlier path gives way."""
    return documents.drop("path").join(files.select("document_id", "path"), "document_id", "left")


def replace_analysis(old: DataFrame, new: DataFrame, analysed: DataFrame) -> DataFrame:
    """Rows of a document that was analysed again (analysed: document_id) are replaced by the new ones, if any."""
    return old.join(analysed.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def analysis_summary(instances: DataFrame) -> DataFrame:
    """(document_id, questions, parsed, review, failed, answered): what an analysis found."""
    status = F.col("extraction_status")
    return instances.groupBy("document_id").agg(
        F.count("*").alias("questions"), F.count_if(status == "PARSED").alias("parsed"), F.count_if(status == "NEEDS_REVIEW").alias("review"),
        F.count_if(status == "FAILED").alias("failed"), F.count_if(F.col("answer_status") != "UNRESOLVED").alias("answered"),
    )


def detail(tables: dict[str, DataFrame], document_id) -> dict[str, DataFrame]:
    """The rows of every table that belong to a document."""
    return {name: rows.where(F.col("document_id") == document_id) for name, rows in tables.items()}


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of documents in gone (document_id)."""
    ids = gone.select("document_id").distinct()
    return {name: rows.join(ids, "document_id", "left_anti") for name, rows in tables.items()}


# --- canonical questions ---------------------------------------------------------------------------------------------


def seeds(canonicals: DataFrame, instances: DataFrame, subject: str | None = None, zero_votes: bool = False) -> DataFrame:
    """(id, stem, question_type, n_members, option_votes): what an import can add to; votes may start anew."""
    rows = canonicals if subject is None else canonicals.where(F.col("subject") == subject)
    n = instances.groupBy(F.col("canonical_id").alias("id")).agg(F.count("*").alias("n_members"), F.sum("votes").alias("option_votes"))
    known = rows.select("id", "stem", "question_type").join(n, "id", "left")
    count = lambda c: (F.lit(0).cast("long") if zero_votes else F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    return known.select("id", "stem", "question_type", count("n_members"), count("option_votes"))


def detach(canonicals: DataFrame, instances: DataFrame, tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonicals, instances and tasks after documents (gone: document_id) were detached.

    Their instances keep no canonical question; canonical questions without any other member go, and their tasks with
    them; those that lost some have ``touched`` set, to be resolved again from the members that are left.
    """
    n = tasks_for(instances)
    ids = gone.select("document_id")
    ids = (ids.repartition(n, "document_id") if n else ids).distinct()  # what is joined is dealt as these are
    flagged = instances.join(ids.withColumn("_gone", F.lit(True)), "document_id", "left")
    lost = flagged.where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.count("_gone").alias("_lost"), F.count("*").alias("_all")).where("_lost > 0")
    dead = lost.where("_lost = _all").select("canonical_id")
    after = canonicals.join(lost, F.col("id") == F.col("canonical_id"), "left").where("_lost IS NULL OR _lost < _all")
    after = after.withColumn("touched", F.col("_lost").isNotNull()).drop("canonical_id", "_lost", "_all")
    freed = flagged.withColumn("canonical_id", F.when(F.col("_gone").isNull(), F.col("canonical_id"))).drop("_gone")
    open_ = tasks.join(ids, "document_id", "left_anti").join(dead, "canonical_id", "left_anti")
    return after, freed, open_


def merged_ids(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows (canonical_id, ...) that point to a merged question's target; merges: source_id, target_id."""
    moved = merges.where("source_id <> target_id").select(F.col("source_id").alias("canonical_id"), "target_id")
    return rows.join(moved, "canonical_id", "left").withColumn("canonical_id", F.coalesce("target_id", "canonical_id")).drop("target_id")


def merged_options(options: DataFrame) -> DataFrame:
    """Options (canonical_id, position, text, normalized, correct, incorrect, selected), each text once: votes add up.

    The first of equal texts, by position, names the option and keeps its place.
    """
    first = F.min(F.struct("position", "text")).alias("f")
    sums = [F.sum(c).alias(c) for c in ("correct", "incorrect", "selected")]
    out = options.groupBy("canonical_id", "normalized").agg(first, *sums)
    return out.select("canonical_id", "f.position", "f.text", "normalized", "correct", "incorrect", "selected")


def merge_canonicals(canonicals: DataFrame, merges: DataFrame, split: DataFrame) -> DataFrame:
    """Canonicals without the merged sources; targets whose members the matcher would split (split: id) need review."""
    left = canonicals.join(merges.where("source_id <> target_id").select(F.col("source_id").alias("id")), "id", "left_anti")
    again = split.select("id", F.lit("NEEDS_REVIEW").alias("_status"))
    return left.join(again, "id", "left").withColumn("answer_status", F.coalesce("_status", "answer_status")).drop("_status")


def update_manual(canonicals: DataFrame, patches: DataFrame) -> DataFrame:
    """Canonicals (id, stem, keys array, valid_keys array, ...) with what people decided (id, stem, keys, approve, in_bank).

    An empty stem and null keys leave what is there; keys that no option has are dropped. An approved question is
    confirmed, certain, free of conflicts, and in the bank unless said otherwise; else only a given in_bank counts.
    """
    given = patches.select("id", F.col("stem").alias("_stem"), F.col("keys").alias("_keys"), F.col("approve").alias("_approve"), F.col("in_bank").alias("_in_bank"))
    rows = canonicals.join(given, "id", "left")
    approved = F.coalesce("_approve", F.lit(False))
    return rows.withColumns({
        "stem": F.coalesce(F.nullif(F.trim("_stem"), F.lit("")), F.col("stem")),
        "keys": F.coalesce(F.filter("_keys", lambda k: F.array_contains("valid_keys", k)), F.col("keys")),
        "answer_status": F.when(approved, "MANUALLY_CONFIRMED").otherwise(F.col("answer_status")),
        "review_status": F.when(approved, "APPROVED").otherwise(F.col("review_status")),
        "confidence": F.when(approved, 1.0).otherwise(F.col("confidence")),
        "in_bank": F.when(approved, F.coalesce("_in_bank", F.lit(True))).otherwise(F.coalesce("_in_bank", "in_bank")),
    }).drop("_stem", "_keys", "_approve", "_in_bank")


def reject(canonicals: DataFrame, ids: DataFrame) -> DataFrame:
    """Canonicals with those named (id) rejected and out of the bank."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    rows = canonicals.join(marked, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumn("review_status", F.when(hit, "REJECTED").otherwise(F.col("review_status"))).withColumn("in_bank", F.col("in_bank") & ~hit).drop("_hit")


def resolve_tasks(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks (task_id, status, ...) with decisions (task_id, action): a dismissed one is DISMISSED, any other RESOLVED."""
    rows = tasks.join(decisions.select("task_id", "action"), "task_id", "left")
    status = F.when(F.col("action") == "dismiss", "DISMISSED").when(F.col("action").isNotNull(), "RESOLVED")
    return rows.withColumn("status", F.coalesce(status, F.col("status"))).withColumnRenamed("action", "resolution")


def close_tasks(tasks: DataFrame, canonicals: DataFrame, but: str = "POSSIBLE_DUPLICATE") -> DataFrame:
    """Tasks with the open ones of decided canonicals (canonical_id) resolved, save those of one kind."""
    marked = canonicals.select("canonical_id").distinct().withColumn("_hit", F.lit(True))
    rows = tasks.join(marked, "canonical_id", "left")
    closes = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "OPEN") & (F.col("kind") != but)
    return rows.withColumn("status", F.when(closes, "RESOLVED").otherwise(F.col("status"))).drop("_hit")


def verifications(stored: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Verdicts (canonical_id, verdict, confidence, suggested_keys) beside the stored ones; nothing is overwritten."""
    return stored.unionByName(verdicts.withColumn("created_at", now), allowMissingColumns=True)


# --- the flat bank and its jobs ----------------------------------------------------------------------------------------


def register_documents(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Documents (id, name) with how many of the questions (document_id, status) each has, and how many lack an answer."""
    n = questions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "missing_answer").alias("missing"))
    return documents.join(n, "id", "left").na.fill(0, ["questions", "missing"])


def without_documents(documents: DataFrame, questions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id) and questions (document_id) without those of the documents in gone (id)."""
    return documents.join(gone.select("id"), "id", "left_anti"), questions.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")


#: What a job may turn into; anything else leaves it as it is.
JOB_STEPS = {"uploaded": ("processing",), "processing": ("completed", "failed"), "failed": ("processing",)}


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs (job_id, state) after one event each (job_id, to): a step that its state allows, and whether it was taken."""
    rows = jobs.join(events.select("job_id", "to"), "job_id", "left")
    allowed = F.lit(False)
    for state, after in JOB_STEPS.items():
        allowed = allowed | ((F.col("state") == state) & F.col("to").isin(*after))
    moved = F.coalesce(allowed, F.lit(False))
    return rows.select("job_id", F.when(moved, F.col("to")).otherwise(F.col("state")).alias("state"), moved.alias("moved"))
