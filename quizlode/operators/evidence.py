"""What marks, scores and statistics of one document say about an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_kind(earned: Column, maximum: Column) -> Column:
    """NO_SCORE, FULL_SCORE, ZERO_SCORE, PARTIAL_SCORE or NEGATIVE_SCORE."""
    return (
        F.when(earned.isNull() | maximum.isNull() | (maximum <= 0), "NO_SCORE")
        .when(F.abs(earned - maximum) < 1e-6, "FULL_SCORE")
        .when(F.abs(earned) < 1e-6, "ZERO_SCORE")
        .when(earned < 0, "NEGATIVE_SCORE")
        .otherwise("PARTIAL_SCORE")
    )


def glyph_meanings(marks: DataFrame) -> DataFrame:
    """(document_id, glyph, n, share, meaning) of marks (document_id, question_id, glyph, score_kind).

    A glyph that stands in two questions or more with full or zero scores means CHECKMARK if 85 % of them were full,
    and CROSS if at most 15 % were.
    """
    seen = marks.where(F.col("score_kind").isin("FULL_SCORE", "ZERO_SCORE")).select("document_id", "question_id", "glyph", "score_kind").distinct()
    shares = seen.groupBy("document_id", "glyph").agg(F.count("*").alias("n"), F.avg((F.col("score_kind") == "FULL_SCORE").cast("int")).alias("share"))
    return shares.withColumn("meaning", F.when(F.col("n") >= 2, F.when(F.col("share") >= 0.85, "CHECKMARK").when(F.col("share") <= 0.15, "CROSS")))


def scored_answer(kind: Column, checks: Column, crosses: Column, picked: Column, mark_confidence: Column) -> Column:
    """(status, confidence, complete) that check marks, crosses and picks prove, given the score's kind."""
    out = lambda status, confidence, complete: F.struct(
        F.lit(status).alias("status"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), F.lit(complete).alias("complete")
    )
    marked = (F.size(checks) > 0) | (F.size(picked) > 0)
    return (
        F.when((kind == "FULL_SCORE") & (F.size(crosses) > 0), out("CONFLICT", 0.4, False))
        .when((kind == "FULL_SCORE") & marked, out("CONFIRMED_BY_SCORE", F.least(F.lit(0.97), 0.9 + 0.07 * mark_confidence), True))
        .when((kind == "PARTIAL_SCORE") & marked, out("NEEDS_REVIEW", 0.55, False))
        .when((kind == "ZERO_SCORE") & (F.size(checks) == 1) & (F.size(crosses) > 0), out("CONFIRMED_BY_DOCUMENT", 0.9 * mark_confidence, True))
        .when((kind == "NO_SCORE") & (F.size(checks) > 0) & (F.size(crosses) == 0), out("CONFIRMED_BY_DOCUMENT", 0.9 * mark_confidence, True))
        .otherwise(out("UNRESOLVED", 0.0, False))
    )


def order_codes(codes: Column) -> Column:
    """Whether printed order codes of two options or more are a permutation of consecutive numbers."""
    low, n = F.array_min(codes), F.size(codes)
    return (n >= 2) & ~F.exists(codes, lambda c: c.isNull()) & (F.array_sort(codes) == F.sequence(low, low + n - 1))


def solve_by_score(n_options: Column, picked: Column, grade: Column, tolerance: float = 0.006) -> Column:
    """The one set of right options (a bit mask) that gives the picked ones this grade, null if there is none or more.

    Of k right options among n, a pick of right and wrong ones earns right / k - wrong / (n - k), not below zero. Sets of 1 to
    n - 1 options are tried, for n from 2 to 10.
    """
    masks = F.sequence(F.lit(1), F.greatest(F.pow(F.lit(2), F.least(n_options, F.lit(10))).cast("int") - 2, F.lit(1)))

    def earns(mask: Column) -> Column:
        k = F.bit_count(mask)
        right = F.bit_count(mask.bitwiseAND(picked))
        wrong = F.bit_count(picked) - right
        value = right / k - wrong / (n_options - k)
        return F.abs(F.greatest(value, F.lit(0.0)) - grade) <= tolerance

    # the sets are tried once
    only = F.get(F.transform(F.array(F.filter(masks, earns)), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))), F.lit(0))
    return F.when(n_options.between(2, 10), only)


def attempts(rows: DataFrame) -> DataFrame:
    """(attempt_id, question_count, first_page, end_page) of question rows (attempt_id, page)."""
    return rows.groupBy("attempt_id").agg(F.count("*").alias("question_count"), F.min("page").alias("first_page"), F.max("page").alias("end_page"))


def typed_answer(n_options: Column, inline: Column, response: Column, kind: Column) -> Column:
    """(text_answer, status, confidence, complete) of a question without options, from an answer printed after it or typed in.

    What the document prints after the question counts most; a typed response counts by its score, and a zero score only
    tells what is wrong.
    """
    said = F.nullif(F.trim(inline), F.lit(""))
    typed = F.nullif(F.trim(response), F.lit(""))
    out = lambda x, status, confidence, complete: F.struct(
        x.cast("string").alias("text_answer"), F.lit(status).alias("status"), F.lit(confidence).cast("double").alias("confidence"), F.lit(complete).alias("complete")
    )
    none = out(F.lit(None), "UNRESOLVED", 0.0, False)
    return (
        F.when(n_options > 0, none)
        .when(said.isNotNull(), out(said, "CONFIRMED_BY_DOCUMENT", 0.88, True))
        .when(typed.isNotNull() & (kind == "FULL_SCORE"), out(typed, "CONFIRMED_BY_SCORE", 0.92, True))
        .when(typed.isNotNull() & (kind == "PARTIAL_SCORE"), out(typed, "NEEDS_REVIEW", 0.5, False))
        .otherwise(none)
    )


def matching_answer(pairs: Column, kind: Column) -> Column:
    """(matching, status, confidence, complete) of options with pairs (text, pair), if all of two and more have one."""
    whole = (F.size(pairs) >= 2) & F.forall(pairs, lambda p: F.coalesce(p["pair"], F.lit("")) != "")
    full = kind == "FULL_SCORE"
    answer = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["text"].alias("key"), p["pair"].alias("value"))))
    return F.when(
        whole,
        F.struct(
            answer.alias("matching"), F.when(full, "CONFIRMED_BY_SCORE").otherwise("NEEDS_REVIEW").alias("status"), F.when(full, 0.9).otherwise(0.5).alias("confidence"), full.alias("complete")
        ),
    )


#: Issues after which a person should look at a question.
BLOCKING_ISSUES = (
    "EMPTY_STEM", "NO_OPTIONS", "SINGLE_OPTION", "UNKNOWN_MARK_GLYPH", "UNASSOCIATED_MARK", "FEEDBACK_UNMATCHED", "FULL_SCORE_WITH_CROSS", "FEEDBACK_CONTRADICTS_MARKS",
    "SINGLE_CHOICE_MULTIPLE_CORRECT", "BOUNDARY_UNCERTAIN", "LOW_OCR_CONFIDENCE", "FORMULA_FROM_OCR", "IMAGE_REFERENCED_BUT_NOT_FOUND", "DUPLICATE_OPTIONS", "EMPTY_OPTION",
    "MARK_NOT_ASSOCIATED", "FORMULA_EXPONENT_MAY_BE_FLATTENED", "FORMULA_EXPONENT_DIGITS_MERGED", "FORMULA_REPLACEMENT_CHAR", "ORDER_CODES_INCOMPLETE",
)


def extraction(stem: Column, n_options: Column, issues: Column, confidence: Column, kind: Column, answer_status: Column, answer_confidence: Column) -> Column:
    """(extraction_status, confidence) of an instance: nothing read, something in doubt, or parsed; an answer limits confidence."""
    blocked = F.arrays_overlap(F.coalesce(issues, F.array().cast("array<string>")), F.array(*[F.lit(i) for i in BLOCKING_ISSUES]))
    empty = (F.coalesce(stem, F.lit("")) == "") & (n_options == 0)
    status = F.when(empty, "FAILED").when(blocked | (confidence < 0.6) | (kind == "UNKNOWN"), "NEEDS_REVIEW").otherwise("PARSED")
    backed = 0.5 + 0.5 * F.greatest(answer_confidence, F.when(answer_status == "UNRESOLVED", 0.6).otherwise(0.0))
    return F.struct(status.alias("extraction_status"), F.round(F.least(confidence, backed), 2).alias("confidence"))
