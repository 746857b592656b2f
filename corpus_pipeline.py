"""The corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet to
the shared folder and read again for the next one. All but the last return the columns of documents; the last returns
them with the words it takes of each document (documents of which it takes none go).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlode.llm import line_templates, minhash, mixing, spaced_seeds, toxicity
from quizlode.llm.common import cut, forget, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The stages learn from labels, hash texts and estimate similarities; no SQL gives the same rows.
ORACLE_SQL: str | None = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under its threshold; it learns from the labels of documents given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars follows the text."""
    found = line_templates.drop_recurring_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), the one with the smallest id.

    Documents without words are in no group and stay; of rows that repeat an id, all stay or none.
    """
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    kept = cut(kept.withColumnRenamed("doc_id", "_kept"), "kept").hint("merge")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: documents with their size, their source's size and target, and the words taken."""
    return mixing.mix_sources(docs, carry=docs.columns).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("minhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, cut(docs, f"stage-{k}")
            forget(before)
    return docs
