"""Records at the edges: pages as they come in, questions as they are kept, votes over figures, rules and review tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .bank import answer_keys

#: Limits of an incoming page: items, characters of an item, width and height where none is given.
MOST_ITEMS, MOST_CHARS, WIDTH, HEIGHT = 20_000, 2_000, 595.0, 842.0


def sanitize_pages(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page, width, height, items) within the limits; items without text are dropped, numbers filled."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    kept = F.filter(F.slice("items", 1, MOST_ITEMS), lambda i: F.coalesce(i["str"], F.lit("")) != "")
    items = F.transform(
        kept, lambda i: F.struct(F.substring(i["str"], 1, MOST_CHARS).alias("str"), zero(i["x"]).alias("x"), zero(i["y"]).alias("y"), zero(i["w"]).alias("w"), zero(i["h"]).alias("h"))
    )
    size = lambda c, d: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(d)).alias(c)
    return pages.where("page >= 1").select("document_id", "page", size("width", WIDTH), size("height", HEIGHT), items.alias("items"))


def is_scanned(pages: DataFrame, least: float = 25.0) -> DataFrame:
    """(document_id, pages, scanned): documents whose pages (document_id, text) have few characters on average."""
    out = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("mean"))
    return out.select("document_id", "pages", (F.col("mean") < least).alias("scanned"))


def has_answer(answer: Column, option_keys: Column, answer_text: Column) -> Column:
    """A key that is among the options; without options, any answer text."""
    by_key = F.size(F.array_intersect(answer_keys(answer), option_keys)) > 0
    return F.when(F.size(option_keys) > 0, by_key).otherwise(F.trim(F.coalesce(answer_text, F.lit(""))) != "")


def confidence_level(x: Column) -> Column:
    return F.when(x >= 0.85, "high").when(x >= 0.6, "medium").otherwise("needs-review")


def structured(n_options: Column, stem_length: Column, answered: Column) -> Column:
    """(question, options, answer, overall): confidence of a flat question's parts by what there is of them."""
    options = F.when(n_options >= 4, 0.98).when(n_options >= 3, 0.85).otherwise(0.6)
    question = F.when(stem_length > 10, 0.99).otherwise(0.8)
    answer = F.when(answered, 0.99).otherwise(0.0)
    overall = F.round((question + options + F.when(answered, answer).otherwise(0.5)) / 3, 2)
    return F.struct(question.alias("question"), options.alias("options"), answer.alias("answer"), overall.alias("overall"))


def figure_labels(votes: DataFrame) -> DataFrame:
    """(figure_id, n, value, weight, trusted): each label's value by votes (figure_id, n, value, earned, maximum).

    A value from a full score wins; else the one of most weight: the share of the score, half without one, at least .05.
    """
    share = F.when(F.col("earned").isNull() | F.col("maximum").isNull() | (F.col("maximum") <= 0), 0.5).otherwise(F.greatest(F.lit(0.05), F.col("earned") / F.col("maximum")))
    full = F.coalesce((F.col("earned") >= F.col("maximum")) & (F.col("maximum") > 0), F.lit(False))
    sums = votes.withColumn("share", share).withColumn("full", full).groupBy("figure_id", "n", "value").agg(F.round(F.sum("share"), 6).alias("weight"), F.max("full").alias("trusted"))
    w = W.partitionBy("figure_id", "n").orderBy(F.desc("trusted"), F.desc("weight"), "value")
    return sums.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def first_known(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The first value, in order, that is known, for each of by; null where none is."""
    return rows.groupBy(*by).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def lone_twins(without: DataFrame, having: DataFrame) -> DataFrame:
    """(id, twin_id): rows (id, key) with the one row of having that shares their key; none where there are several."""
    once = having.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("twin_id")).where("n = 1")
    return without.join(once, "key").select("id", "twin_id")


def override(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """Questions (id, question, answer) with the answer of the first rule (priority, fragment, answer) whose fragment they hold.

    Rules are a short list that people write: it goes to every row as one array, in order of priority.
    """
    listed = rules.agg(F.array_sort(F.collect_list(F.struct("priority", "fragment", "answer"))).alias("r"))
    rows = questions.select("id", "question", "answer").withColumn("listed", listed.scalar())
    first = F.get(F.filter("listed", lambda r: F.contains(F.col("question"), r["fragment"])), F.lit(0))
    rows = rows.withColumn("given", first)
    return rows.select("id", "question", F.coalesce(F.col("given")["answer"], "answer").alias("answer"), F.col("given").isNotNull().alias("overridden"))


def review_tasks(canonicals: DataFrame) -> DataFrame:
    """(id, kind) of canonicals (id, answer_status, extraction_status): what a person should look at."""
    answer = F.when(F.col("answer_status") == "CONFLICT", "ANSWER_CONFLICT").when(F.col("answer_status") == "NEEDS_REVIEW", "ANSWER_REVIEW").when(F.col("answer_status") == "UNRESOLVED", "NO_ANSWER")
    extraction = F.when(F.col("extraction_status") == "FAILED", "EXTRACTION_FAILED").when(F.col("extraction_status") == "NEEDS_REVIEW", "EXTRACTION_REVIEW")
    return canonicals.select("id", F.explode(F.array_compact(F.array(answer, extraction))).alias("kind"))


def most_frequent_set(members: DataFrame) -> DataFrame:
    """(group_id, keys, n): the answer set (sorted, comma-joined) that most members (group_id, keys array) give; first of equals."""
    sets = members.select("group_id", F.array_join(F.array_sort("keys"), ",").alias("keys")).groupBy("group_id", "keys").agg(F.count("*").alias("n"))
    w = W.partitionBy("group_id").orderBy(F.desc("n"), "keys")
    return sets.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def unique_sources(sources: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` sources (question_id, url, rank) of each question, each address once."""
    once = sources.groupBy("question_id", "url").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("rank", "url"))
    return once.withColumn("place", place).where(F.col("place") <= most)


def valid_uploads(files: DataFrame, most_bytes: int = 150 << 20) -> DataFrame:
    """Files (path, length, modified) that are PDFs of a fitting size, the same name, size and time once."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    fits = F.lower("name").endswith(".pdf") & (F.col("length") > 0) & (F.col("length") <= most_bytes)
    return named.where(fits).groupBy("name", "length", "modified").agg(F.min("path").alias("path"))


_ITEM = "struct<number:string,question:string,options:map<string,string>,correctAnswer:string,explanation:string>"


def parse_answers(replies: DataFrame) -> DataFrame:
    """Questions of JSON replies (id, json), a list or an object with one: number, question, options, answer, confidence, status.

    Code fences around the JSON go, keys of options and answers are normalised, and an answer "unknown" is none. Confidence
    is by the number of options, and high only if the answer is one of four. A reply that is no such JSON has no rows.
    """
    plain = text.strip(F.regexp_replace("json", "(?i)```(?:json)?", ""))
    items = F.when(plain.startswith("["), F.from_json(plain, f"array<{_ITEM}>")).otherwise(F.from_json(plain, f"struct<questions:array<{_ITEM}>>")["questions"])
    rows = replies.select("id", F.posexplode(items).alias("i", "x")).where(F.coalesce(F.col("x.question"), F.lit("")) != "")
    options = F.transform_values(F.transform_keys(F.coalesce("x.options", F.create_map().cast("map<string,string>")), lambda k, v: text.option_key(k)), lambda k, v: F.trim(v))
    answer = text.option_key(F.nullif(F.col("x.correctAnswer"), F.lit("")))
    rows = rows.select("id", "i", "x", options.alias("options"), F.when(~F.lower(answer).isin("unknown", "null"), answer).alias("answer"))
    n, known = F.size("options"), F.map_contains_key("options", F.coalesce("answer", F.lit("")))
    confidence = F.when((n >= 4) & known, "high").when((n >= 3) & F.col("answer").isNotNull(), "medium").otherwise("needs-review")
    status = F.when(confidence != "needs-review", "answered").when((n >= 3) & F.col("answer").isNull(), "missing_answer").otherwise("needs_review")
    number = F.coalesce(F.try_to_number(F.regexp_extract("x.number", "^[0-9]{1,9}", 0), F.lit("999999999")).cast("int"), F.col("i") + 1)
    return rows.select("id", number.alias("number"), F.trim("x.question").alias("question"), "options", "answer", confidence.alias("confidence"), status.alias("status"), F.col("x.explanation").alias("explanation"))


#: Prompts of figures, and from which share of a stem's words on they are a figure's captions.
FIGURE_PROMPT, CAPTION_SHARE, LEAST_WORD = r"^(?:Назовите|Укажите|Подпишите|Обозначьте|Определите)", 0.6, 4


def figure_noise(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """(id): questions (id, page, question, options map) that are a figure's list of labels read as text.

    figures: first_page, last_page, labels (array). A question on their pages or the one before is noise if it lists
    numbers, ends in one, is a prompt with numbered options, or consists of their captions' words.
    """
    pages = figures.select(F.explode(F.sequence(F.greatest(F.col("first_page") - 1, F.lit(1)), F.col("last_page"))).alias("page")).distinct()
    words = lambda x: F.array_distinct(F.filter(F.split(F.translate(F.lower(x), "ё", "е"), r"[^\p{L}]+"), lambda w: F.length(w) >= LEAST_WORD))
    captions = figures.select(F.explode("labels").alias("l")).select(F.explode(words(F.col("l"))).alias("word")).distinct().withColumn("known", F.lit(1))
    near = questions.join(pages, "page", "left_semi")
    listed = F.regexp_count("question", F.lit(r"(?:^|\s)\d{1,2}[.)]\s")) >= 2
    cut_off = F.col("question").rlike(r"(?:^|\s)\d{1,2}[.)]?\s*$") & F.col("question").rlike(r"^[^?]*\p{L}")
    numbered = F.size(F.filter(F.map_values("options"), lambda o: o.rlike(r"\s\d{1,2}[.)]\s")))
    prompt = (numbered >= 1) & (F.size("options") >= 2) & F.col("question").rlike(f"(?iu){FIGURE_PROMPT}")
    said = near.select("id", (listed | cut_off | prompt).alias("bare"), F.explode_outer(words(F.col("question"))).alias("word")).join(captions, "word", "left")
    share = said.groupBy("id").agg(F.max("bare").alias("bare"), F.count("word").alias("n"), F.count("known").alias("hits"))
    return share.where(F.col("bare") | (F.col("n") == 0) | (F.col("hits") >= CAPTION_SHARE * F.col("n"))).select("id")
