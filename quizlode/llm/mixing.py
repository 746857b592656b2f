"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are ranged by that key within their source (equal key ranges, so that even a
source with a third of all rows is spread evenly), token counts are summed per range, and the sums of the ranges become
offsets: a prefix sum over the whole source that no single task ever sees. The mix is cut where the prefix sum reaches
the source's budget; a source whose budget exceeds its size is repeated: full epochs first, then the cut.

Only one range of a source holds its cut. A running sum over the ids and sizes of that range finds the row at the cut;
every other row is judged where it lies, by comparing its key with the one of that row, so no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Bits of a row's random key; the first RANGE_BITS of them name its range within the source.
KEY_BITS, RANGE_BITS = 60, 12
#: Rows of some 100 bytes, one for each source, up to which they are broadcast; beyond, rows are joined by source.
MOST_SOURCES = 100_000


def random_key(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of an MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """A source as a key that is never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most_epochs: float) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    Sources take the weights in turn, by code point, null last. Together they get ``share`` of all sizes; no target
    exceeds ``most_epochs`` times its source's size, and what that leaves over is dealt again by weight. One row per
    source goes through the windows below, never a row per document.
    """
    n = len(weights)
    ranked = sizes.select(
        "source", "source_size", (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).alias("_rank")
    )
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % n + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most_epochs)))
    by_fill = W.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    all_w = F.sum("_w").over(everything)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        all_w - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    last = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(everything)
    return ranked.select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(last * F.col("_w")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: list[float] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 7,
    carry: list[str] = (),
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): what the mix takes of it.

    Returns doc_id, size (words of the text), source_size, target (words that the mix wants of the source), taken
    (words taken, repeats counted) and the columns of ``carry``. The sum of ``taken`` over a source is the whole part
    of its target; the document at the cut is taken in part. Null texts have size 0 and take nothing; a null source is
    a source of its own, the last; rows that repeat a doc_id are ordered by size among themselves; an empty table gives
    no rows; other columns of ``docs`` are ignored. A carried column named as one of the five gives way to it.
    """
    keyed = docs.select(
        F.col("doc_id").alias("doc_id"),
        _source_key(F.col("source")).alias("_in"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        random_key(F.col("doc_id"), seed).alias("_key"),
        F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row"),
    )
    cuts = cut(source_cuts(keyed.drop("_row"), list(weights), share, most_epochs), "mix-cuts")
    few, copies = cuts.agg(F.count("*") <= MOST_SOURCES, F.max("_copies")).first()
    placed = keyed.join(F.broadcast(cuts) if few else cuts, F.col("_in") == F.col("_s"))
    own = F.struct("_key", "doc_id", "size")
    first_copy = F.least(F.col("size"), F.col("_left"))
    at_cut = F.coalesce(own == F.col("_at"), F.lit(False))
    taken = F.when(at_cut, first_copy).when(own < F.col("_at"), F.col("size")).otherwise(F.lit(0))
    placed = placed.withColumn("_more", taken)
    if copies and copies > 1:
        # rows that repeat the id and size at a cut take of what is left one after another
        ordinal = F.row_number().over(W.partitionBy("_in").orderBy(F.xxhash64(F.col("_row.text")))) - 1
        again = F.least(F.col("size"), F.greatest(F.col("_left") - ordinal * F.col("size"), F.lit(0)))
        placed = placed.where(~at_cut).unionByName(placed.where(at_cut).withColumn("_more", again))
    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
        *[F.col("_row")[c].alias(c) for c in carry if c not in ("doc_id", "size", "source_size", "target", "taken")],
    )


def source_cuts(keyed: DataFrame, weights: list[float], share: float, most_epochs: float) -> DataFrame:
    """One row for each source of ``keyed`` (doc_id, _in, size, _key): its target, full epochs, and the row at its cut.

    _at is that row as (_key, doc_id, size), null in a source without words; _left is what it takes and _copies how many
    rows are equal to it.
    """
    keyed = keyed.withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS))
    ranges = cut(keyed.groupBy("_in", "_range").agg(F.sum("size").alias("_sum")), "mix-ranges")
    sizes = ranges.groupBy("_in").agg(F.sum("_sum").alias("source_size"))
    sizes = sizes.select(F.when(F.col("_in") != "", F.substring("_in", 2, 1 << 30)).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.select(_source_key(F.col("source")).alias("_s"), "source_size", "target", epochs.cast("long").alias("_epochs"))
    targets = targets.withColumn("_whole", F.floor("target") - F.col("_epochs") * F.col("source_size"))
    targets = cut(targets, "mix-targets")
    offsets = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(W.partitionBy("_in").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = offsets.join(targets, F.col("_in") == F.col("_s")).where("_before <= _whole AND _whole < _before + _sum")
    inside = cut(inside.select("_s", F.col("_range").alias("_r"), "_before", "_whole"), "mix-inside")
    near = keyed.join(inside, (F.col("_in") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    before = W.partitionBy("_in").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    equal = near.groupBy(F.col("_in").alias("_of"), F.struct("_key", "doc_id", "size").alias("_at")).agg(
        (F.first("_whole") - F.min("_start")).alias("_left"), F.count("*").alias("_copies")
    )
    found = equal.where((F.col("_left") >= 0) & (F.col("_left") < F.col("_copies") * F.col("_at")["size"]))
    return targets.join(found, F.col("_s") == F.col("_of"), "left").drop("_of", "_whole")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by weights 5, 2, 1 to 150 % of their words, at most two epochs of a source."""
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rnk % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap
      FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM s)),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS lvl
      FROM w),
t AS (SELECT source, source_size,
             CASE WHEN cap / w <= lvl THEN cap
                  ELSE w * (SELECT lvl FROM l WHERE cap / w > lvl ORDER BY cap / w, rnk LIMIT 1) END AS target
      FROM l),
p AS (SELECT doc_id, source, size,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d),
e AS (SELECT p.doc_id, p.size, p.start, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(floor(target)::BIGINT - epochs * source_size - start, 0)))::BIGINT AS taken
FROM e
"""
