"""The question bank: search, counts, review lists, de-duplication, merges and keyed rewrites.

Every function takes and returns DataFrames; nothing is collected. Sorts that cut a page carry a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def like(x: Column, sought: str) -> Column:
    """Case-blind substring, with % and _ taken literally."""
    return F.lower(x).contains(sought.lower())


def answer_keys(x: Column) -> Column:
    """"A,C" as its parts."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,;|]"), lambda k: F.trim(k)), lambda k: k != "")


def search(
    bank: DataFrame, query: str | None = None, status: str = "all", confidence: str = "all", category: str = "all", document: str = "all",
    texts: tuple[str, ...] = ("question", "category", "document"),
) -> DataFrame:
    """Rows that hold the query in one of their texts (or have it as answer) and pass the filters; "all" passes any.

    Of the statuses, "approved" means verified and "review" means without an answer.
    """
    out = bank
    if query:
        hit = F.upper("answer") == query.upper()
        for c in texts:
            hit = hit | like(F.col(c), query)
        out = out.where(F.coalesce(hit, F.lit(False)))
    if status == "review":
        out = out.where(F.size(answer_keys(F.col("answer"))) == 0)
    elif status != "all":
        out = out.where(F.col("status") == ("verified" if status == "approved" else status))
    for name, value in (("confidence", confidence), ("category", category), ("document", document)):
        if value != "all":
            out = out.where(F.col(name) == value)
    return out


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page (1 on; at least 5 rows) of the rows in that order."""
    size = max(5, size)
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def facet(bank: DataFrame, column: str) -> DataFrame:
    return bank.groupBy(column).agg(F.count("*").alias("n"))


def stats(bank: DataFrame) -> DataFrame:
    """One row of counts: by status (each row in the first that fits), answered, and distinct categories."""
    verified, pending = F.col("status") == "verified", F.col("status") == "pending"
    review = (F.col("status") == "review") | (F.col("confidence") == "needs-review")
    return bank.agg(
        F.count("*").alias("total"),
        F.count_if(verified).alias("verified"),
        F.count_if(~verified & pending).alias("pending"),
        F.count_if(~verified & ~pending & review).alias("review"),
        F.count_if(F.size(answer_keys(F.col("answer"))) > 0).alias("answered"),
        F.count_distinct("category").alias("categories"),
    )


def review_tasks(tasks: DataFrame, canonicals: DataFrame, documents: DataFrame, status: str = "OPEN", kind: str | None = None, most: int = 300) -> DataFrame:
    """Tasks of a status in order of id, with their question's stem and document's name where those exist."""
    out = tasks.where(F.col("status") == status)
    if kind:
        out = out.where(F.col("kind") == kind)
    out = out.orderBy("task_id").limit(most)
    return out.join(canonicals, "canonical_id", "left").join(documents, "document_id", "left")


def duplicate_groups(rows: DataFrame, key: Column) -> DataFrame:
    """(id, first, size) of rows (id) that share a non-empty key with others: their group's smallest id, and how many it has."""
    keyed = rows.select("id", key.alias("key")).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(groups, "key").select("id", "first", "size")


def dedupe(rows: DataFrame, key: Column, has_answer: Column) -> DataFrame:
    """One row (id, attempts, ...) per key: the first with an answer, else the first; attempts added up."""
    keyed = rows.withColumn("_key", key).withColumn("_has", has_answer)
    w = W.partitionBy("_key")
    keyed = keyed.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_has"), "id")))
    keyed = keyed.withColumn("_first", F.min("id").over(w)).withColumn("_attempts", F.sum("attempts").over(w))
    return keyed.where("_rank = 1").drop("attempts").withColumnRenamed("_attempts", "attempts").drop("_key", "_has", "_rank")


def merge_into(bank: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bank and incoming rows (key, answer): new keys are added, answers fill bank rows that lack one.

    Returns key, answer and change (added, filled or kept). The first incoming row of a key (by id) counts.
    """
    once = incoming.groupBy("key").agg(F.min_by("answer", F.struct(F.col("answer").isNull(), "id")).alias("new"), F.lit(True).alias("came"))
    both = bank.select("key", "answer", F.lit(True).alias("there")).join(once, "key", "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("answer").isNull() & F.col("new").isNotNull(), "filled").otherwise("kept")
    return both.select("key", F.coalesce("answer", "new").alias("answer"), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of every key; of one version the new one wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def write_canonicals(old: DataFrame, new: DataFrame, locked: list[str]) -> DataFrame:
    """New canonical rows (id, ...) over the old ones; rows a person decided (is_manual) keep their locked columns."""
    columns = [c for c in old.columns if c not in ("id", "is_manual")]
    a = old.select("id", "is_manual", *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("_old"))
    b = new.select("id", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_new"))
    both = a.join(b, "id", "full")
    manual = F.coalesce("is_manual", F.lit(False))
    pick = lambda c: F.when(F.col("_new").isNull() | (manual & F.lit(c in locked)), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c)
    return both.select("id", manual.alias("is_manual"), *[pick(c) for c in columns])


def approve(bank: DataFrame, ids: DataFrame) -> DataFrame:
    """The bank with the status of the rows named in ids (id) set to verified."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return bank.join(marked, "id", "left").withColumn("status", F.when(F.col("_hit"), "verified").otherwise(F.col("status"))).drop("_hit")


def delete(bank: DataFrame, ids: DataFrame) -> DataFrame:
    return bank.join(ids.select("id"), "id", "left_anti")
