"""From answered instances to the questions of a bank: groups, votes, status, letters, and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleanup, text
from ..sources.stages import StageLog
from . import engine, records, resolve

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that a blank question has at least, and that a copy with its blanks filled has more than it at most.
LEAST_WORDS, MOST_FILLED = 3, 6


def members(instances: DataFrame, groups: DataFrame) -> DataFrame:
    """Instances with the canonical question they belong to; groups: instance_id, canonical_id."""
    return instances.join(groups.select("instance_id", "canonical_id"), "instance_id")


def option_votes(members: DataFrame) -> DataFrame:
    """(canonical_id, option, text, position, correct, incorrect, selected, picked): options of equal text are one.

    position: the first place, in order of documents, where the option stands; picked: members with a partial score
    marked it.
    """
    rows = members.select("canonical_id", "document_id", "sequence", "score_kind", "complete", "right", "wrong", F.posexplode("options").alias("i", "o"))
    right, wrong = F.array_contains("right", F.col("i")), F.array_contains("wrong", F.col("i"))
    partial = F.col("score_kind") == "PARTIAL_SCORE"
    place = F.struct("document_id", "sequence", "i")
    return rows.groupBy("canonical_id", text.match_key(F.col("o.text")).alias("option")).agg(
        F.min_by("o.text", place).alias("text"), F.min(place).alias("position"), F.count_if(right & ~partial).alias("correct"), F.count_if(wrong & ~partial).alias("incorrect"),
        F.count_if(right | wrong).alias("selected"), F.coalesce(F.bool_or(right & partial), F.lit(False)).alias("picked"),
    )


def canonicals(members: DataFrame) -> DataFrame:
    """Canonical questions of members: stem, type, options in order, status, confidence, right options, order, pairs, text.

    members: canonical_id, document_id, sequence, stem, type, options, right, wrong, right_order (positions), matching,
    text_answer, score_kind, status, confidence, complete.
    """
    place = F.struct("document_id", "sequence")
    votes = option_votes(members)
    options = votes.groupBy("canonical_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "option", "text", "correct", "incorrect", "picked"))).alias("ordered")
    )
    about = members.groupBy("canonical_id").agg(
        F.count("*").alias("n_members"), F.min_by("stem", place).alias("stem"), F.min(place).alias("first"), F.bool_or(F.col("type") == "MULTIPLE_CHOICE").alias("multi"),
        F.coalesce(F.bool_or(F.col("complete") & (F.col("status") == "CONFIRMED_BY_DOCUMENT")), F.lit(False)).alias("by_document"),
        F.coalesce(F.max(F.when(F.col("complete"), F.col("confidence"))), F.lit(0.0)).alias("best"),
    )
    right_texts = F.transform("right", lambda i: text.match_key(F.get("options", i)["text"]))
    sets = resolve.complete_sets(members.where(F.col("complete") & (F.size("right") > 0)).select("canonical_id", right_texts.alias("keys")))
    both = about.join(options, "canonical_id", "left").join(sets, "canonical_id", "left").na.fill(0, ["n_complete", "n_sets"])
    numbered = F.transform(F.coalesce("ordered", F.array()), lambda o, i: F.struct(i.alias("option"), o["correct"].alias("correct"), o["incorrect"].alias("incorrect"), o["picked"].alias("picked")))
    judged = resolve.resolve(both.withColumn("options", numbered))
    ordered = F.transform("right_order", lambda i: text.match_key(F.get("options", i)["text"]))
    carried = resolve.carried_over(judged, members.withColumn("right_order", ordered))
    names = F.transform(F.coalesce("ordered", F.array()), lambda o: o["text"])
    keys = F.transform(F.coalesce("ordered", F.array()), lambda o: o["option"])
    kept = both.select("canonical_id", "stem", "first", "n_members", names.alias("options"), keys.alias("option_keys"))
    return kept.join(carried, "canonical_id")


def letter(i: Column) -> Column:
    return F.when(i < len(LETTERS), F.substr(F.lit(LETTERS), i + 1, F.lit(1))).otherwise((i + 1).cast("string"))


def to_flat(questions: DataFrame) -> DataFrame:
    """Canonical questions as rows of a bank: question, options by letter, answer letters or text, confidence and status.

    A true or false question that lost a choice gets it back. Pairs and orders are told as text. What can't be read, has
    contradicting answers or no answer is for review.
    """
    options = F.transform("options", cleanup.clean_option)
    low = F.lower(F.get(options, F.lit(0)))
    lone = (F.size("options") == 1) & low.isin("верно", "неверно")
    choices = F.when(lone & (low == "верно"), F.array(F.lit("Верно"), F.lit("Неверно"))).when(lone, F.array(F.lit("Неверно"), F.lit("Верно"))).otherwise(options)
    rows = questions.withColumn("choices", choices)
    right = F.array_sort(F.filter(F.transform(F.split("correct_keys", ","), lambda k: F.try_to_number(F.nullif(k, F.lit("")), F.lit("99999")).cast("int")), lambda k: k.isNotNull()))
    rows = rows.withColumn("picked", right)
    shown = lambda key: F.coalesce(F.get("choices", F.array_position("option_keys", key).cast("int") - 1), key)
    pairs = F.array_join(F.transform(F.map_entries("matching"), lambda e: F.concat(shown(text.match_key(e["key"])), F.lit(" → "), e["value"])), "; ")
    order = F.array_join(F.transform("right_order", shown), " → ")
    said = F.when(F.col("text_answer").isNotNull(), cleanup.clean_answer(F.col("text_answer"))).when(F.col("matching").isNotNull(), pairs).when(F.size("right_order") > 0, order)
    letters = F.nullif(F.array_join(F.transform("picked", letter), ","), F.lit(""))
    texts = F.array_join(F.transform("picked", lambda i: F.get("choices", i)), "; ")
    stem = cleanup.clean_stem(F.col("stem"))
    unreadable = cleanup.is_unreadable(stem) | cleanup.is_ocr_garbage(stem)
    conflict = F.col("answer_status") == "CONFLICT"
    rows = rows.withColumn("question", stem).withColumn("answer", letters).withColumn("answer_text", F.coalesce(F.when(letters.isNotNull(), texts), said)).withColumn("unreadable", unreadable)
    answered = F.col("answer").isNotNull() | F.col("answer_text").isNotNull()
    level = records.confidence_level(F.col("confidence"))
    doubtful = conflict | F.col("unreadable")
    named = F.map_from_entries(F.transform("choices", lambda o, i: F.struct(letter(i).alias("key"), o.alias("value"))))
    return rows.select(
        F.col("canonical_id").alias("id"), "first", "question", named.alias("options"), "answer", "answer_text",
        F.when(~answered | doubtful, "needs-review").otherwise(level).alias("confidence"),
        F.when(~answered, "missing_answer").when(doubtful | (level == "needs-review"), "needs_review").otherwise("answered").alias("status"), "unreadable", F.col("n_members").alias("attempts"),
    )


def filled_candidates(rows: DataFrame) -> DataFrame:
    """(id, w, short): unanswered questions and the originals (words) that they may repeat, as ``filled_copies`` tells.

    Two words in a row of the original may be apart by what was filled in, so copies meet originals by the pair of
    neighbours that the fewest originals have. Originals of equal words meet as one.
    """
    open_ = rows.where(F.size("options") == 0).select("id", "status", text.words(F.col("question")).alias("w"))
    originals = open_.where(F.size("w") >= LEAST_WORDS).groupBy(F.col("w").alias("short")).agg(F.min("id").alias("least"), F.max("id").alias("most"))
    pair = lambda w, i, j: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + j))
    own = F.transform(F.sequence(F.lit(0), F.size("short") - 2), lambda i: pair("short", i, F.lit(1)))
    pairs = originals.select("short", "least", "most", F.explode(F.array_distinct(own)).alias("pair"))
    counted = pairs.join(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair")
    originals = counted.groupBy("short", "least", "most").agg(F.min(F.struct("n", "pair"))["pair"].alias("pair"))
    long = open_.where("status = 'missing_answer'").where(F.size("w") > LEAST_WORDS)
    ahead = F.sequence(F.lit(1), F.lit(MOST_FILLED + 1))
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.transform(ahead, lambda j: pair("w", i, j))))
    # a long question has many pairs, so its words join those that are met and don't travel with each pair
    copies = long.select("id", F.size("w").alias("n_words"), F.explode(F.array_distinct(F.array_compact(near))).alias("pair"))
    more = F.col("n_words") - F.size("short")
    other = (F.col("id") != F.col("least")) | (F.col("id") != F.col("most"))
    met = copies.join(originals, "pair").where(other & more.between(1, MOST_FILLED)).select("id", "short")
    return met.join(long.select("id", "w"), "id").select("id", "w", "short")


def filled_copies(rows: DataFrame) -> DataFrame:
    """(id): unanswered questions (id, question, options map, status) that repeat one without options with words in its blanks.

    The copy has the words of the original in its order, and one to six more.
    """
    # how far into the original the copy's words lead
    reach = F.aggregate("w", F.lit(0), lambda k, w: F.when(F.get("short", k) == w, k + 1).otherwise(k))
    return filled_candidates(rows).where(reach == F.size("short")).select("id").distinct()


def bank(rows: DataFrame) -> DataFrame:
    """The flat questions to keep: no unanswered heading, noise or filled copy."""
    missing = F.col("status") == "missing_answer"
    rows = rows.where(~(missing & F.col("unreadable"))).where(~(missing & (F.size("options") == 0) & cleanup.is_heading(F.col("question"))))
    return rows.join(filled_copies(rows), "id", "left_anti").withColumn("document_id", F.col("first.document_id"))


def build(instances: DataFrame, folder: str, log: StageLog | None = None) -> DataFrame:
    """Answered instances to the questions of a bank; ``folder`` is shared with the executors, ``log`` notes what is written."""
    kept = (log or StageLog()).kept
    keyed = kept(instances.where(F.trim("stem") != "").withColumn("id", F.xxhash64("instance_id")), f"{folder}/instances")
    named = keyed.withColumn("option_texts", F.transform("options", lambda o: text.match_key(o["text"])))
    stems = named.select("id", "document_id", "sequence", "stem", "key", F.col("option_texts").alias("options"), "type")
    groups = resolve.cluster(stems, folder).select("id", "canonical_id")
    rows = keyed.join(groups, "id").drop("id")
    if "matching" not in rows.columns:
        rows = rows.withColumn("matching", F.lit(None).cast("map<string,string>")).withColumn("text_answer", F.lit(None).cast("string"))
    return bank(kept(to_flat(canonicals(kept(rows, f"{folder}/members"))), f"{folder}/questions"))


def extract(pages: DataFrame, folder: str, log: StageLog | None = None) -> DataFrame:
    """Positioned pages (document_id, page, items) to the questions of a bank."""
    return build(engine.analyze(pages), folder, log)
