"""Groups of equal questions that grow by imports.

A store keeps the groups (their first question, and the options of all members), which distinct questions are in them,
and an inverted index of the blocking keys of their first questions. An import reads the index, not the groups: only
groups that share a key with a new question and have a stem alike are loaded, and only components of such groups and new
questions are decided, in order, from the groups as they are. What an import changes is published as one step (deltas
beside the old ones, see ``sources.versions``), so its work follows the import and the groups that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import kept, removed, versions, work_folder
from . import resolve

_GROUPS = "id long, document_id string, sequence long, stem string, key string, type string, generic boolean, options array<string>"
_MEMBERS = "name long, stem string, key string, options array<string>, type string, canonical_id long"
_INDEX = "block string, n_grams int, id long"

_SAME = ("stem", "key", "options", "type")


def groups(spark: SparkSession, store: str) -> DataFrame:
    """The groups (id, document_id, sequence, stem, key, type, generic, options) as the last import left them."""
    rows = versions.published(spark, store, "groups", _GROUPS)
    columns = [c.split()[0] for c in _GROUPS.split(", ")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "delta").alias("g")).select("id", "g.*")


def _known(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(id, canonical_id) of rows whose question is a member already."""
    other = members.select(F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in _SAME], "canonical_id")
    match = F.col("name") == F.col("_name")
    for c in _SAME:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, match).select("id", "canonical_id")


def import_questions(rows: DataFrame, store: str) -> DataFrame:
    """Add rows (id long, document_id, sequence, stem, key, options, type) to the groups of a store and return their groups.

    Returns (id, canonical_id, review_of) as ``resolve.cluster`` does: a group is named by its first question. Importing
    documents one after another, in their order, gives the groups of importing all of them at once. Ids are new ones;
    rows without a stem are in no group; an import without rows changes nothing.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "import")
    named = rows.where(F.coalesce("stem", F.lit("")) != "").withColumn("options", F.array_sort("options")).withColumn("sequence", F.col("sequence").cast("long"))
    named = kept(named.select("id", "document_id", "sequence", *_SAME, F.xxhash64(*_SAME).alias("name")), f"{folder}/rows")
    members = versions.published(spark, store, "members", _MEMBERS)
    first = named.groupBy("name", *_SAME).agg(F.min(F.struct("document_id", "sequence", "id")).alias("f")).select("name", *_SAME, "f.*")
    first = kept(first, f"{folder}/distinct")
    old = kept(_known(first, members), f"{folder}/known")
    fresh = resolve.with_grams(first.join(old.select("id"), "id", "left_anti"))
    fresh = kept(fresh, f"{folder}/fresh")

    # groups whose first question shares a block and could be alike by size, from the index alone
    index = versions.published(spark, store, "index", _INDEX)
    blocks = fresh.select(F.explode("blocks").alias("block"), F.col("n_grams").alias("n"))
    sizes = blocks.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    near = index.join(sizes, "block").where((F.col("n_grams") >= resolve.LEAST_LIKENESS * F.col("least")) & (F.col("most") >= resolve.LEAST_LIKENESS * F.col("n_grams")))
    seeds = groups(spark, store).join(near.select("id").distinct(), "id", "left_semi")
    seeds = kept(resolve.with_grams(seeds), f"{folder}/seeds")

    pairs = resolve.met(fresh, fresh, f"{folder}/fresh-fresh")
    if versions.manifest(spark, store):
        pairs = pairs.unionByName(resolve.met(fresh, seeds, f"{folder}/fresh-seeds"))
    pairs = kept(resolve.joinable(pairs), f"{folder}/pairs")
    found = resolve.components(pairs, folder)
    columns = ["id", "document_id", "sequence", "options", "generic"]
    nodes = fresh.select(*columns, F.lit(False).alias("seed")).unionByName(seeds.select(*columns, F.lit(True).alias("seed")))
    replayed = resolve.replayed(nodes, pairs, found)
    plain = F.array_sort(F.array_distinct(F.filter("options", lambda o: o != "")))
    alone = fresh.join(found.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("canonical_id"), F.lit(None).cast("long").alias("review_of"), plain.alias("options"))
    decided = kept(replayed.unionByName(alone), f"{folder}/decided")

    placed = decided.where("id IS NOT NULL").select("id", "canonical_id", "review_of")
    begun = fresh.join(decided.where("id = canonical_id").select("id", F.col("options").alias("_options")), "id").withColumn("options", F.col("_options"))
    grown = seeds.join(decided.where("id IS NULL").select(F.col("canonical_id").alias("id"), F.col("options").alias("_options")), "id")
    grown = grown.where(F.col("_options") != F.array_sort("options")).withColumn("options", F.col("_options"))
    columns = [c.split()[0] for c in _GROUPS.split(", ")]
    versions.publish(
        spark, store,
        {
            "groups": begun.select(*columns).unionByName(grown.select(*columns)),
            "members": fresh.join(placed, "id").select("name", *_SAME, "canonical_id"),
            "index": begun.select(F.explode("blocks").alias("block"), "n_grams", "id"),
        },
    )
    own = placed.unionByName(old.withColumn("review_of", F.lit(None).cast("long")))
    first_of = first.join(own.withColumnRenamed("id", "_of"), F.col("id") == F.col("_of")).select("name", *[F.col(c).alias(f"_{c}") for c in _SAME], "_of", "canonical_id", "review_of")
    match = [named["name"] == first_of["name"]] + [named[c].eqNullSafe(F.col(f"_{c}")) for c in _SAME]
    out = named.join(first_of.withColumnRenamed("name", "_name"), [F.col("name") == F.col("_name"), *match[1:]])
    out = kept(out.select("id", "canonical_id", F.when(F.col("id") == F.col("_of"), F.col("review_of")).alias("review_of")), f"{folder}/out")
    removed(spark, *(f"{folder}/{t}" for t in ("rows", "distinct", "known", "fresh", "seeds", "decided")))
    return out
