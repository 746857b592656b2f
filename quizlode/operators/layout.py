"""Lines of pages: running heads, roles, profiles and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text


def margins(lines: DataFrame) -> DataFrame:
    """The first and last line of each page of lines (document, page, pos, line)."""
    w = W.partitionBy("document", "page")
    ends = lines.withColumn("last", F.max("pos").over(w))
    return ends.where((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).drop("last")


def running_noise(lines: DataFrame) -> DataFrame:
    """(document, key, pages): margin texts, digits alike, that recur on enough pages of a document.

    Enough is three tenths of its pages, but three at least and six at most; documents of fewer than three pages have none.
    """
    keyed = margins(lines).select("document", "page", text.noise_key(F.col("line")).alias("key")).where("key <> ''").distinct()
    pages = lines.select("document", "page").distinct().groupBy("document").agg(F.count("*").alias("n"))
    counts = keyed.groupBy("document", "key").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(3), F.least(F.ceil(F.col("n") * 0.3), F.lit(6)))
    return counts.join(pages, "document").where((F.col("n") >= 3) & (F.col("pages") >= enough)).select("document", "key", "pages")


def without_running_noise(lines: DataFrame) -> DataFrame:
    """Lines without the margin lines that are running noise."""
    keyed = lines.withColumn("key", text.noise_key(F.col("line")))
    edge = margins(lines).select("document", "page", "pos", F.lit(True).alias("edge"))
    marked = keyed.join(edge, ["document", "page", "pos"], "left")
    noise = running_noise(lines).select("document", "key", F.lit(True).alias("noise"))
    return marked.join(noise, ["document", "key"], "left").where(F.col("edge").isNull() | F.col("noise").isNull()).drop("key", "edge", "noise")


def source_type(headers: Column, scores: Column, meta: Column, signs: Column, pages: Column, ocr_pages: Column) -> Column:
    """What kind of document its counted lines make it."""
    return (
        F.when(ocr_pages > 0.6 * pages, "SCANNED")
        .when((headers > 0) & (scores > 0) & (meta > 0), "MOODLE_EXPORT")
        .when((headers > 0) & (scores > 0), "LMS_EXPORT")
        .when(signs >= 4, "PLUS_MINUS_BANK")
        .when(headers >= 2, "NUMBERED_LIST")
        .otherwise("UNKNOWN")
    )


def coverage(instances: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, expected, found, missing, balanced) of instances and expected questions (document_id, number)."""
    # one aggregate of both sides instead of two and a join; a missing key equals no other
    yes, no = F.lit(1), F.lit(None).cast("int")
    side = lambda rows, e, f: rows.select("document_id", "number", e.alias("e"), f.alias("f"))
    both = side(expected, yes, no).unionByName(side(instances, no, yes))
    apart = F.when(F.col("document_id").isNull() | F.col("number").isNull(), F.col("e").isNull())
    both = both.groupBy("document_id", "number", apart.alias("_apart")).agg(F.max("e").alias("e"), F.max("f").alias("f"))
    out = both.groupBy("document_id").agg(F.count("e").alias("expected"), F.count("f").alias("found"), F.count_if(F.col("f").isNull()).alias("missing"))
    return out.withColumn("balanced", (F.col("missing") == 0) & (F.col("expected") == F.col("found")))


def number_gaps(rows: DataFrame) -> DataFrame:
    """(document_id, sequence, previous, gap, restarts) where numbering (document_id, sequence, number) leaps or falls back."""
    w = W.partitionBy("document_id").orderBy("sequence")
    rows = rows.withColumn("previous", F.lag("number").over(w))
    rows = rows.withColumn("gap", F.col("number") - F.col("previous")).withColumn("restarts", F.col("gap") <= 0)
    return rows.where((F.col("gap") > 1) | F.col("restarts")).select("document_id", "sequence", "previous", "gap", "restarts")


def vertical_gaps(lines: DataFrame) -> DataFrame:
    """(block, lines, least, most, varied) of the distances between lines (block, pos, y)."""
    w = W.partitionBy("block").orderBy("pos")
    gaps = lines.withColumn("gap", F.col("y") - F.lag("y").over(w))
    out = gaps.groupBy("block").agg(F.count("*").alias("lines"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return out.withColumn("varied", F.coalesce((F.col("most") - F.col("least") > 1) & (F.col("most") > 1.25 * F.col("least")), F.lit(False)))


def question_type(rows: DataFrame) -> DataFrame:
    """(id, type, confidence) of rows with what is known of a question.

    rows: id, stem, multi (tri-state) and kind (MATCHING, ORDERING, TEXT) of the instruction, options (texts), codes, pairs,
    checks, plus, selected (counts), has_image, has_table, has_formula, feedback. Every cue adds its weight to a type; the
    heaviest wins (the one with the earlier cue of equals), unless two heavy ones of different structure are close, which
    makes a combination. The confidence follows the winner's share and its lead.
    """
    n = F.size("options")
    says = lambda p: F.lower(F.coalesce("stem", F.lit(""))).rlike(f"(?iu){p}")
    kind, several = F.coalesce("kind", F.lit("")), F.col("multi")
    picture, told = says(rules.STEM_PICTURE), F.trim(F.coalesce("feedback", F.lit("")))
    right = F.greatest("checks", "plus")
    cues = [
        ("MATCHING", 4.0, kind == "MATCHING"),
        ("ORDERING", 4.0, kind == "ORDERING"),
        ("SHORT_TEXT", 2.0, (kind == "TEXT") & (n == 0)),
        ("SINGLE_CHOICE", 2.0, (kind == "TEXT") & (n > 0)),
        ("MULTIPLE_CHOICE", 4.0, several),
        ("SINGLE_CHOICE", 4.0, ~several),
        ("MATCHING", 3.0, says(rules.STEM_MATCHING)),
        ("ORDERING", 3.0, says(rules.STEM_ORDERING)),
        ("MULTIPLE_CHOICE", 2.0, says(rules.STEM_SEVERAL)),
        ("IMAGE_IDENTIFICATION", 3.0, picture & F.col("has_image")),
        ("IMAGE_IDENTIFICATION", 1.5, picture & ~F.col("has_image")),
        ("IMAGE_LABELING", 3.0, says(rules.STEM_LABELS) & F.col("has_image")),
        ("ORDERING", 1.5, F.col("codes") >= 2),
        ("MATCHING", 1.0, F.col("codes") >= 2),
        ("MATCHING", 3.0, F.col("pairs") >= 2),
        ("TRUE_FALSE", 5.0, (n == 2) & F.forall("options", lambda o: F.trim(o).rlike(f"(?iu){rules.TRUE_FALSE_WORDS}"))),
        ("SINGLE_CHOICE", 1.0, n >= 2),
        ("MULTIPLE_CHOICE", 3.0, (n >= 2) & (right >= 2)),
        ("MULTIPLE_CHOICE", 2.0, (n >= 2) & (F.col("selected") >= 2)),
        ("SINGLE_CHOICE", 1.0, (n >= 2) & (right == 1) & ~F.coalesce(several, F.lit(False))),
        ("NUMERIC", 3.0, (n == 0) & says(rules.STEM_NUMBER)),
        ("NUMERIC", 2.0, (n == 0) & told.rlike(r"^-?\d+(?:[.,]\d+)?\s*\S{0,6}\z")),
        ("FORMULA", 2.0, (n == 0) & F.col("has_formula")),
        ("TABLE", 2.0, (n == 0) & F.col("has_table")),
        ("SHORT_TEXT", 2.0, (n == 0) & (told != "")),
        ("SHORT_TEXT", 0.5, (n == 0) & (told == "")),
        ("TABLE", 0.5, F.col("has_table") & (n >= 2)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(w).alias("w"))) for i, (t, w, c) in enumerate(cues)]))
    rows = rows.select("id", found.alias("cues"))
    sums = F.transform(
        F.array_distinct(F.transform("cues", lambda c: c["t"])),
        lambda t: F.struct(
            (-F.aggregate(F.filter("cues", lambda c: c["t"] == t), F.lit(0.0), lambda s, c: s + c["w"])).alias("s"),
            F.array_min(F.transform(F.filter("cues", lambda c: c["t"] == t), lambda c: c["i"])).alias("i"),
            t.alias("t"),
        ),
    )
    rows = rows.select("id", F.array_sort(sums).alias("r"), F.aggregate("cues", F.lit(0.0), lambda s, c: s + c["w"]).alias("total"))
    best, second = -F.get("r", F.lit(0))["s"], -F.get("r", F.lit(1))["s"]
    first, other = F.get("r", F.lit(0))["t"], F.get("r", F.lit(1))["t"]
    choices = list(rules.CHOICE_TYPES)
    mixed = (second >= 3) & (best - second < 0.5) & ~(first.isin(choices) & other.isin(choices))
    margin = F.coalesce((best - second) / F.greatest(best, F.lit(1.0)), F.lit(1.0))
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.99), 0.5 * (best / F.col("total")) + 0.5 * margin + F.when(best >= 4, 0.1).otherwise(0.0)))
    return rows.select(
        "id",
        F.when(F.size("r") == 0, "UNKNOWN").when(mixed, "COMBINATION").otherwise(first).alias("type"),
        F.when(F.size("r") == 0, 0.0).when(mixed, 0.55).otherwise(F.round(confidence, 2)).alias("confidence"),
    )


def subjects(texts: DataFrame, terms: DataFrame, least: int = 3) -> DataFrame:
    """(id, subject, hits, confidence): the subject of which texts (id, text) hold most terms (subject, term), if enough.

    terms is a word list that people write: it goes to every row as one array, so that no text is joined or shuffled.
    """
    listed = terms.groupBy("subject").agg(F.collect_list("term").alias("terms"))
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("subject", "terms"))).alias("s"))
    rows = texts.select("id", F.lower("text").alias("low")).withColumn("listed", listed.scalar())
    places = lambda t: ((F.length("low") - F.length(F.replace("low", t, F.lit("")))) / F.length(t)).cast("int")
    count = lambda s: F.struct((-F.aggregate(s["terms"], F.lit(0), lambda n, t: n + places(t))).alias("n"), s["subject"].alias("subject"))
    rows = rows.select("id", F.array_sort(F.filter(F.transform("listed", count), lambda c: c["n"] < 0)).alias("ranked"))
    hits, second = -F.get("ranked", F.lit(0))["n"], F.coalesce(-F.get("ranked", F.lit(1))["n"], F.lit(0))
    best = rows.select("id", F.get("ranked", F.lit(0))["subject"].alias("subject"), hits.cast("long").alias("hits"), second.alias("second")).where(F.col("hits") >= least)
    confidence = F.least(F.lit(0.95), 0.4 + 0.6 * (F.col("hits") - F.col("second")) / F.col("hits"))
    return best.select("id", "subject", "hits", F.round(confidence, 6).alias("confidence"))


def subject_hints(texts: DataFrame) -> DataFrame:
    """(id, hints): subjects of which texts (id, text) hold two terms or more, in the subjects' order."""
    low = F.lower(F.coalesce("text", F.lit("")))
    marks = []
    for subject, terms in rules.SUBJECT_TERMS.items():
        hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
        marks.append(F.when(hits >= 2, F.lit(subject)))
    return texts.select("id", F.array_compact(F.array(*marks)).alias("hints"))


def audit(found: DataFrame) -> DataFrame:
    """Counted documents (document_id, expected, found, orphans, failed, conflicts) with problems and status.

    A document is complete if nothing is missing, no line belongs nowhere and no question failed; conflicts alone don't
    keep it from that, but are named.
    """
    say = lambda test, what: F.when(test, F.lit(what))
    missing, orphans, failed = F.col("expected") > F.col("found"), F.col("orphans") > 0, F.col("failed") > 0
    problems = F.array_compact(F.array(say(missing, "MISSING_QUESTIONS"), say(orphans, "ORPHAN_LINES"), say(failed, "FAILED_QUESTIONS"), say(F.col("conflicts") > 0, "ANSWER_CONFLICTS")))
    return found.withColumn("problems", problems).withColumn("status", F.when(missing | orphans | failed, "PROCESSING_INCOMPLETE").otherwise("COMPLETE"))


def orphans(lines: DataFrame, used: DataFrame) -> DataFrame:
    """Lines (document_id, page, pos, role) that are neither noise nor used (document_id, page, pos) by anything."""
    return lines.where("role <> 'NOISE'").join(used.select("document_id", "page", "pos"), ["document_id", "page", "pos"], "left_anti")


def rhythm_blocks(lines: DataFrame) -> DataFrame:
    """Lines (block, pos, page, y, h) with item: which of a block's unlabelled items (from 0) each is of, by vertical rhythm.

    A line goes on with the item before it if the distances in its block vary (by more than 2 and than 0.35 of the first
    line's height) and its own is under 0.6 of the largest one. A line on another page begins an item; a distance
    across pages is larger than any.
    """
    w = W.partitionBy("block").orderBy("pos")
    every = W.partitionBy("block")
    across = F.lag("page").over(w) != F.col("page")
    lines = lines.withColumn("_gap", F.when(across, F.lit(float("inf"))).otherwise(F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)))
    within = F.when(F.col("_gap") < float("inf"), F.col("_gap"))
    most = F.greatest(F.max(within).over(every), F.lit(0.0))
    first = F.first("h").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    varied = most - F.min("_gap").over(every) > F.greatest(first * 0.35, F.lit(2.0))
    lines = lines.withColumn("_begins", ~F.coalesce(varied & (F.col("_gap") < 0.6 * most), F.lit(False)))
    return lines.withColumn("item", F.sum(F.col("_begins").cast("int")).over(w).cast("int") - 1).drop("_gap", "_begins")
