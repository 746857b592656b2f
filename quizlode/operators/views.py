"""What the screens show: filters, counters, orders, de-duplication of parts, and the pool of a quiz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .bank import answer_keys, like

# --- filters ---------------------------------------------------------------------------------------------------------


def review_screen(rows: DataFrame, shown: str = "all", query: str | None = None) -> DataFrame:
    """Extracted questions (number, question, options map, status, confidence) of one filter that hold the query.

    shown: all, answered, missing_answer, needs_review (by confidence) or high_confidence.
    """
    which = {
        "answered": F.col("status") == "answered", "missing_answer": F.col("status") == "missing_answer",
        "needs_review": F.col("confidence") == "needs-review", "high_confidence": F.col("confidence") == "high",
    }
    rows = rows.where(which[shown]) if shown in which else rows
    query = (query or "").strip()
    if query:
        hit = F.col("number").cast("string").contains(query.lower()) | like(F.col("question"), query) | F.exists(F.map_values("options"), lambda o: like(o, query))
        rows = rows.where(F.coalesce(hit, F.lit(False)))
    return rows


def document_instances(instances: DataFrame, attempt=None, shown: str = "all") -> DataFrame:
    """Instances (attempt_id, extraction_status, answer_status) of an attempt and a filter: review, failed or noanswer."""
    rows = instances if attempt is None else instances.where(F.col("attempt_id") == attempt)
    if shown == "review":
        return rows.where((F.col("extraction_status") == "NEEDS_REVIEW") | F.col("answer_status").isin("NEEDS_REVIEW", "CONFLICT"))
    wanted = {"failed": F.col("extraction_status") == "FAILED", "noanswer": F.col("answer_status") == "UNRESOLVED"}
    return rows.where(wanted[shown]) if shown in wanted else rows


def is_figure(image_id: Column, tags: Column) -> Column:
    return (F.coalesce(image_id, F.lit("")) != "") | F.coalesce(F.array_contains(tags, "figure"), F.lit(False))


def quiz_mode(rows: DataFrame, mode: str = "all") -> DataFrame:
    """Questions (image_id, tags) with a picture, without one, or all."""
    figure = is_figure(F.col("image_id"), F.col("tags"))
    return rows.where(figure) if mode == "figures" else rows.where(~figure) if mode == "text" else rows


def lookup_targets(rows: DataFrame, failed: DataFrame, version: int) -> DataFrame:
    """Questions (id, question, has_answer, origin, lookup_version) to look answers up for.

    Those without an answer or with one a model made, not yet looked up in this version, whose stem has three characters
    or more and that did not fail before (failed: id).
    """
    open_ = ~F.col("has_answer") | F.coalesce(F.col("origin") == "ai", F.lit(False))
    fresh = F.coalesce("lookup_version", F.lit(0)) < version
    return rows.where(open_ & fresh & (F.length(F.trim("question")) >= 3)).join(failed.select("id"), "id", "left_anti")


def flat(rows: DataFrame) -> DataFrame:
    """Nested bank rows (id, number, question, options array of (key, text), answer (key, text), ...) as flat questions."""
    key, said = F.col("answer")["key"], F.col("answer")["text"]
    answered = (F.coalesce(key, F.lit("")) != "") | (F.coalesce(said, F.lit("")) != "")
    return rows.select(
        "id", "number", F.col("number").cast("string").alias("raw_number"), "question", F.map_from_entries("options").alias("options"),
        F.nullif(key, F.lit("")).alias("correct_answer"), said.alias("answer_text"), F.when(answered, "answered").otherwise("missing_answer").alias("status"),
    )


def edited(options: Column, answer: Column) -> Column:
    """(valid, confidence, status) of a question that a person wrote: two filled options at least, and what the answer leaves."""
    n = F.size(F.filter(options, lambda o: F.trim(o) != ""))
    answered = F.size(answer_keys(answer)) > 0
    confidence = F.when(answered & (n >= 4), "high").when(answered, "medium").otherwise("needs-review")
    return F.struct((n >= 2).alias("valid"), confidence.alias("confidence"), F.when(answered, "answered").otherwise("missing_answer").alias("status"))


def labelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Rows with the label and tone of a column's value; labels: value, label, tone (one row a value); unknown ones name themselves."""
    out = rows.join(labels.withColumnRenamed("value", column), column, "left")
    return out.withColumn("label", F.coalesce("label", column))


# --- counters --------------------------------------------------------------------------------------------------------


def extraction_stats(rows: DataFrame) -> DataFrame:
    """One row: questions (status, confidence) in all, answered, without an answer, for review, and of high confidence."""
    status, level = F.col("status"), F.col("confidence")
    return rows.agg(
        F.count("*").alias("all"), F.count_if(status == "answered").alias("answered"), F.count_if(status == "missing_answer").alias("missing_answer"),
        F.count_if(level == "needs-review").alias("needs_review"), F.count_if(level == "high").alias("high_confidence"),
    )


def answer_stats(rows: DataFrame, key: Column, has_answer: Column) -> DataFrame:
    """One row: questions (id) that differ in their key, and how many of them, each by its first row, have an answer."""
    first = rows.select(key.alias("key"), "id", has_answer.alias("has")).groupBy("key").agg(F.min_by("has", "id").alias("has"))
    return first.agg(F.count("*").alias("unique"), F.count_if("has").alias("answered"), F.count_if(~F.col("has")).alias("missing"))


def dashboard(documents: DataFrame, rows: DataFrame, key: Column, has_answer: Column, figure: Column) -> DataFrame:
    """(name, n), the dashboard's numbers: documents, unique, answered, missing and figures."""
    counts = documents.agg(F.lit("documents").alias("name"), F.count("*").alias("n"))
    figures = rows.agg(F.lit("figures").alias("name"), F.count_if(figure).alias("n"))
    return counts.unionByName(answer_stats(rows, key, has_answer).unpivot([], ["unique", "answered", "missing"], "name", "n")).unionByName(figures)


def document_counters(instances: DataFrame) -> DataFrame:
    """(document_id, answer_status, n, answered): a document's histogram of answers, and how many are confirmed in all."""
    n = instances.groupBy("document_id", "answer_status").agg(F.count("*").alias("n"))
    confirmed = F.sum(F.when(F.col("answer_status").startswith("CONFIRMED"), F.col("n")).otherwise(0)).over(W.partitionBy("document_id"))
    return n.withColumn("answered", confirmed)


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median, upper): the mean of the middle two values, and the upper of them."""
    xs = F.array_sort(F.collect_list(value))
    return rows.groupBy(by).agg(F.percentile(value, 0.5).alias("median"), F.get(xs, F.floor(F.count(value) / 2).cast("int")).alias("upper"))


def mean_confidence(pages: DataFrame) -> DataFrame:
    """(document_id, confidence): the mean over pages of the mean over their words (document_id, page, conf)."""
    page = pages.groupBy("document_id", "page").agg(F.avg("conf").alias("c"))
    return page.groupBy("document_id").agg(F.round(F.avg("c"), 4).alias("confidence"))


# --- orders ----------------------------------------------------------------------------------------------------------


def natural_order(options: Column) -> Column:
    """Options (key, ...) by number where the key is one, else by text after those."""
    number = lambda o: F.try_to_number(F.when(o["key"].rlike("^[0-9]{1,9}$"), o["key"]), F.lit("999999999"))
    ranked = F.array_sort(F.transform(options, lambda o: F.struct(number(o).isNull().alias("word"), number(o).alias("n"), o["key"].alias("k"), o.alias("o"))))
    return F.transform(ranked, lambda x: x["o"])


#: Labels of options, and Cyrillic letters that look like them.
LABELS, LOOKALIKES = "abcde", ("асе", "ace")


def label_letter(label: Column) -> Column:
    """a to e, or null."""
    low = F.translate(F.lower(F.coalesce(label, F.lit(""))), *LOOKALIKES)
    return F.when(low.rlike("^[a-e]$"), low)


def label_order(options: Column) -> Column:
    """Options (label, ...) in order of their letters if all have one; equal letters keep their order."""
    every = F.forall(options, lambda o: label_letter(o["label"]).isNotNull())
    ranked = F.array_sort(F.transform(options, lambda o, i: F.struct(label_letter(o["label"]).alias("l"), i.alias("i"), o.alias("o"))))
    return F.when(every, F.transform(ranked, lambda x: x["o"])).otherwise(options)


def keywords(x: Column, most: int = 6, least: int = 4) -> Column:
    """The longest distinct words, the first of equally long ones first."""
    words = F.array_distinct(F.filter(text.words(x), lambda w: F.length(w) >= least))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["w"])


def largest_image(figures: DataFrame, images: DataFrame) -> DataFrame:
    """(figure_id, image_id): the largest image (page, image_id, y, w, h) that ends above the figure's first label (page, figure_id, top)."""
    above = images.join(figures, "page").where(F.col("y") + F.col("h") / 2 < F.col("top"))
    best = F.max_by("image_id", F.struct(F.col("w") * F.col("h"), -F.col("image_id"))).alias("image_id")
    return above.groupBy("figure_id").agg(best)


def sample(rows: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """``most`` rows (id) at random, the same ones for the same seed, with a shuffled rank."""
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"))).orderBy("draw", "id").limit(most)
    return drawn.withColumn("place", F.row_number().over(W.orderBy("draw", "id"))).drop("draw")


def shuffled(options: Column, id_: Column, seed: int = 0) -> Column:
    """Options (key, ...) in an order that depends on question and seed alone."""
    ranked = F.array_sort(F.transform(options, lambda o: F.struct(F.xxhash64(F.lit(seed), id_, o["key"]).alias("h"), o.alias("o"))))
    return F.transform(ranked, lambda x: x["o"])


# --- parts and files -------------------------------------------------------------------------------------------------

#: Sequence numbers of one file lie below this stride.
STRIDE = 1_000_000


def joined_parts(*parts: DataFrame) -> DataFrame:
    """Questions of several files (sequence) on end, each with its place over all: the file's number times the stride, and its own."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("place", F.lit(k * STRIDE) + F.col("sequence"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def renumbered(rows: DataFrame, by: str, *order) -> DataFrame:
    """Rows with ``number``: 1, 2, ... in each of ``by``."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def figure_key(captions: Column) -> Column:
    """The captions as a set: normalised, sorted, joined; empty if none has letters."""
    return F.array_join(F.array_sort(F.filter(F.transform(captions, text.dedupe_key), lambda c: c != "")), "|")


def first_of_key(rows: DataFrame, key: Column, order: str = "id") -> DataFrame:
    """The first row of every key; rows with an empty key are all kept."""
    keyed = rows.withColumn("_key", key)
    rank = F.row_number().over(W.partitionBy("_key").orderBy(order))
    # rows without a key never meet in one partition
    kept = keyed.where("_key <> ''").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return kept.unionByName(keyed.where("coalesce(_key, '') = ''")).drop("_key")


def publication_key(question: Column, options: Column, image_id: Column) -> Column:
    """Stem, sorted options and picture: what makes two published questions one."""
    parts = F.array_sort(F.transform(options, text.dedupe_key))
    return F.concat_ws("¦", text.dedupe_key(question), F.array_join(parts, "|"), F.coalesce(image_id, F.lit("")))


def publish(rows: DataFrame) -> DataFrame:
    """The bank to publish (id, question, options, answer, image_id): each question once, numbered; unanswered rows fail it."""
    once = first_of_key(rows, publication_key(F.col("question"), F.col("options"), F.col("image_id")))
    checked = once.withColumn("answer", F.when(F.size(answer_keys(F.col("answer"))) > 0, F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("no answer: "), F.col("id").cast("string")))))
    return checked


# --- the pool of a quiz ----------------------------------------------------------------------------------------------


def quiz_pool(rows: DataFrame) -> DataFrame:
    """Questions (id, question, options array of (key, text), answer, answer_text, image_id, tags, ordered, matching) to ask.

    Of questions alike in stem and options the first counts; what has no answer is left out. ``kind`` is sequence or
    matching (their slots are the answer), figure (captions to place), choice or text; ``correct`` are the keys to pick.
    """
    texts = F.transform("options", lambda o: o["text"])
    rows = first_of_key(rows, F.concat_ws("¦", text.answer_key_text(F.col("question")), F.array_join(F.array_sort(F.transform(texts, text.answer_key_text)), "|")))
    keys = F.transform("options", lambda o: o["key"])
    correct = F.filter(answer_keys(F.col("answer")), lambda k: F.array_contains(keys, k))
    typed = F.when(F.size("options") == 0, F.trim(F.coalesce("answer_text", F.lit("")))).otherwise(F.lit(""))
    slots = F.col("ordered") | F.col("matching")
    rows = rows.withColumn("correct", correct).withColumn("typed", typed).where(slots | (F.size("correct") > 0) | (F.col("typed") != ""))
    tagged = F.coalesce(F.array_contains("tags", "figure"), F.lit(False))
    figure = is_figure(F.col("image_id"), F.col("tags")) & (F.size("options") >= 2) & (tagged | (F.size("correct") == 0))
    kind = F.when(F.col("ordered"), "sequence").when(F.col("matching"), "matching").when(figure, "figure").when(F.size("correct") > 0, "choice").otherwise("text")
    shown = F.when(kind == "figure", natural_order(F.col("options"))).otherwise(F.col("options"))
    asked = F.when(kind.isin("sequence", "matching"), F.array().cast("array<string>")).when(kind == "figure", F.transform(natural_order(F.col("options")), lambda o: o["key"])).otherwise(F.col("correct"))
    return rows.select("id", "question", kind.alias("kind"), shown.alias("options"), asked.alias("correct"), F.when(kind == "text", F.col("typed")).otherwise(F.lit("")).alias("text_answer"))
