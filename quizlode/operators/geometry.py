"""Joins by place on a page: nearest, within, and last before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest(marks: DataFrame, options: DataFrame, factor: float = 1.2, least_height: float = 8.0) -> DataFrame:
    """(mark_id, option_id, dy): each mark's (page, mark_id, y, h) closest option (page, option_id, oy), if close enough.

    Of equally close options the one with the smaller id counts. Pages are small; the join is on the page.
    """
    both = marks.join(options, "page").withColumn("dy", F.abs(F.col("y") - F.col("oy")))
    both = both.where(F.col("dy") <= factor * F.greatest("h", F.lit(least_height)))
    best = both.groupBy("mark_id").agg(F.min(F.struct("dy", "option_id")).alias("m"))
    return best.select("mark_id", "m.option_id", "m.dy")


def within(images: DataFrame, blocks: DataFrame, margin: float = 4.0) -> DataFrame:
    """(image_id, block_id) where an image's centre (page, cy) lies in a block's span (page, top, bottom), give or take a margin."""
    both = images.join(blocks, "page")
    return both.where(F.col("cy").between(F.col("top") - margin, F.col("bottom") + margin)).select("image_id", "block_id")


def last_before(events: DataFrame, starts: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Events (by, at, ...) with the value of the last start (by, at, value) at or before them, null before the first.

    One sort of both sides together; no pairs are made.
    """
    columns = [c for c in events.columns if c not in (by, at)]
    a = events.select(by, at, F.struct(*columns).alias("event"), F.lit(None).cast(starts.schema[value].dataType).alias(value), F.lit(1).alias("_side"))
    b = starts.select(by, at, F.lit(None).cast(a.schema["event"].dataType).alias("event"), value, F.lit(0).alias("_side"))
    w = W.partitionBy(by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return out.where("_side = 1").select(by, at, "event.*", value)


def owners(notes: DataFrame, questions: DataFrame, above: float = 6.0, below: float = 20.0, farthest: float = 40.0) -> DataFrame:
    """(note_id, question_id): the question (page, question_id, top, bottom) of a note (page, note_id, y, h).

    The one it overlaps most, its span reaching a little over both ends; without any the nearest, if not too far; the
    smaller id of equals. Pages are small and a note is on one; the join is on the page, and so are the choices.
    """
    both = notes.join(questions, "page")
    overlap = F.least(F.col("y") + F.col("h"), F.col("bottom") + below) - F.greatest(F.col("y"), F.col("top") - above)
    both = both.withColumn("overlap", overlap).where(F.col("overlap") > -farthest)
    best = both.groupBy("page", "note_id").agg(F.max_by("question_id", F.struct("overlap", -F.col("question_id"))).alias("question_id"))
    return best.select("note_id", "question_id")


def stamped_options(stamps: DataFrame, options: DataFrame, share: float = 0.62, most: float = 14.0) -> DataFrame:
    """(stamp_id, option_id): the option (page, question_id, option_id, y, bottom) of its question whose middle is nearest to a
    stamp's (page, question_id, stamp_id, y, h) weight, which lies low in it; null if none is near: a mark by hand."""
    both = stamps.select("page", "question_id", "stamp_id", (F.col("y") + share * F.col("h")).alias("at")).join(
        options.select("page", "question_id", "option_id", ((F.col("y") + F.col("bottom")) / 2).alias("middle")), ["page", "question_id"], "left"
    )
    gap = F.abs(F.col("at") - F.col("middle"))
    best = both.groupBy("stamp_id").agg(F.min(F.struct(gap.alias("gap"), "option_id")).alias("b"))
    return best.select("stamp_id", F.when(F.col("b.gap") < most, F.col("b.option_id")).alias("option_id"))


def note_rows(notes: DataFrame, rows: DataFrame, most: float = 20.0) -> DataFrame:
    """(note_id, row_id): the row (question_id, row_id, y) nearest to a typed note (question_id, note_id, y), if within reach."""
    both = notes.withColumnRenamed("y", "note_y").join(rows, "question_id").withColumn("gap", F.abs(F.col("note_y") - F.col("y"))).where(F.col("gap") <= most)
    return both.groupBy("note_id").agg(F.min(F.struct("gap", "row_id")).alias("b")).select("note_id", "b.row_id")


def table_runs(lines: DataFrame) -> DataFrame:
    """(page, first, last, n_cells): runs of two neighbouring lines (page, pos, n_cells) and more with as many cells, two at least."""
    w = W.partitionBy("page").orderBy("pos")
    changes = F.coalesce((F.lag("n_cells").over(w) != F.col("n_cells")) | (F.lag("n_cells").over(w) < 2), F.lit(True)) | (F.col("n_cells") < 2)
    runs = lines.withColumn("run", F.sum(changes.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("n_cells >= 2")
    found = runs.groupBy("page", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n_cells").alias("n_cells"), F.count("*").alias("n"))
    return found.where("n >= 2").select("page", "first", "last", "n_cells")


def joined_glyphs(items: DataFrame) -> DataFrame:
    """Glyphs (page, pos, str, x, y, w, h) that touch on one baseline as words; blank glyphs keep their neighbours apart."""
    w = W.partitionBy("page").orderBy("pos")
    blank = F.trim("str") == ""
    height = F.when(F.col("h") > 0, F.col("h")).otherwise(10.0)
    before = lambda c: F.lag(c).over(w)
    touches = ~before("blank") & (F.abs(before("y") - F.col("y")) < 0.5) & (F.abs(F.col("x") - before("end")) <= F.greatest(F.lit(0.6), 0.12 * height))
    rows = items.withColumn("blank", blank).withColumn("end", F.col("x") + F.col("w"))
    rows = rows.withColumn("starts", ~F.coalesce(touches, F.lit(False)) | F.col("blank"))
    rows = rows.withColumn("word", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where(~F.col("blank"))
    out = rows.groupBy("page", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "str"))), lambda g: g["str"]), "").alias("str"), F.min("x").alias("x"), F.max("end").alias("end"), F.min_by("y", "pos").alias("y"))
    return out.select("page", "word", "str", "x", "y", (F.col("end") - F.col("x")).alias("w"))
