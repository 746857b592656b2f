"""Rule parser: page text to numbered questions with options, answers and a verdict on each.

Pages are exploded into lines; a running count of header lines names the block of each line (one window per document,
over lines alone); blocks are put together again and taken apart by patterns, all in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text


def page_lines(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line_index, line) of pages (document_id, page_number, text)."""
    return pages.select("document_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_index", "line"))


def question_blocks(pages: DataFrame) -> DataFrame:
    """(document_id, block, number, raw_number, page_number, block_text).

    A block starts at a line with a number from 1 to 500 and ends before the next one; the rest of a page from a
    heading of an answer key on belongs to none, and neither does what follows on later pages before a new number.
    """
    lines = page_lines(pages)
    by_page = W.partitionBy("document_id", "page_number").orderBy("line_index")
    stop = F.col("line").rlike(f"(?iu){rules.KEY_HEADING}")
    lines = lines.withColumn("stopped", F.max(stop.cast("int")).over(by_page))
    number = text.bengali_to_digits(F.regexp_extract("line", f"(?iu){rules.QUESTION_START}", 1)).try_cast("int")
    lines = lines.withColumn("number", F.when((F.col("stopped") == 0) & number.between(1, 500), number))
    by_doc = W.partitionBy("document_id").orderBy("page_number", "line_index")
    event = F.when(F.col("number").isNotNull(), 1).when((F.col("stopped") == 1), 1).otherwise(0)
    lines = lines.withColumn("block", F.sum(event).over(by_doc))
    body = F.when(F.col("number").isNotNull(), F.trim(F.regexp_replace("line", f"(?iu){rules.QUESTION_START}", ""))).otherwise(F.col("line"))
    part = F.struct("page_number", "line_index", body.alias("body"), "number", F.regexp_extract("line", f"(?iu){rules.QUESTION_START}", 1).alias("raw"))
    blocks = lines.where("stopped = 0").groupBy("document_id", "block").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    head = F.get("parts", F.lit(0))
    blocks = blocks.where(head["number"].isNotNull())
    joined = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    return blocks.select(
        "document_id", "block", head["number"].alias("number"), head["raw"].alias("raw_number"), head["page_number"].alias("page_number"),
        F.regexp_replace(joined, r"^\n", "").alias("block_text"),
    )


def answer_keys(texts: DataFrame) -> DataFrame:
    """(document_id, number, answer) of the answer-key section of texts (document_id, text); the first of a number counts.

    The section starts at its heading line; an entry needs a sign between number and letter, so a year is no entry.
    """
    start = rf"(?isu)(?:^|\n)\s*(?:Answer\s*Keys?|Answers|Solutions|Exam\s*Key|উত্তরমালা|সমাধান|সঠিক\s*উত্তরসমূহ)\s*[:\-–—]?(.*)\z"
    section = F.regexp_extract("text", start, 1)
    numbers, letters = (F.regexp_extract_all(section, F.lit(rules.KEY_ITEM), F.lit(g)) for g in (1, 2))
    items = texts.select("document_id", F.posexplode(F.arrays_zip(numbers.alias("n"), letters.alias("a"))).alias("pos", "item"))
    items = items.select("document_id", "pos", text.bengali_to_digits(F.col("item.n")).cast("int").alias("number"), text.option_key(F.col("item.a")).alias("answer"))
    return items.groupBy("document_id", "number").agg(F.min_by("answer", "pos").alias("answer"))


def clean_lines(x: Column) -> Column:
    """The lines that are neither empty nor noise, trimmed."""
    lines = F.transform(F.split(x, "\n"), text.strip)
    return F.array_join(F.filter(lines, lambda line: (line != "") & ~text.is_noise_line(line)), "\n")


def clean_option(x: Column) -> Column:
    """An option's lines up to the first that is an explanation, an answer or noise, as one line."""
    lines = F.filter(F.transform(F.split(x, "\n"), text.strip), lambda line: line != "")
    stops = F.transform(lines, lambda line: line.rlike(f"(?iu){rules.OPTION_STOP}") | line.rlike(f"(?iu)^{rules.INLINE_ANSWER}") | text.is_noise_line(line))
    first = F.array_position(stops, True)
    kept = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return text.collapse(F.array_join(kept, " "))


def options_of(block: Column) -> Column:
    """(question, options) of a block: markers A, B, C ... in this order part the text, others are text."""
    pattern = f"(?u){rules.OPTION_MARKER}"
    markers, pieces = F.regexp_extract_all(block, F.lit(pattern), F.lit(0)), F.split(block, pattern, -1)
    empty = F.struct(F.get(pieces, F.lit(0)).alias("question"), F.array().cast("array<string>").alias("options"))
    rows = F.arrays_zip(markers.alias("m"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["options"])
        wanted = F.substr(F.lit(rules.OPTION_LETTERS), n + 1, F.lit(1))
        fits = (text.option_key(text.strip(F.regexp_replace(x["m"], r"[\s।]", ""))) == wanted) & (n < len(rules.OPTION_LETTERS))
        more = F.concat(x["m"], x["p"])
        head = F.slice(acc["options"], F.lit(1), F.greatest(n - 1, F.lit(0)))
        return F.struct(
            F.when(fits | (n > 0), acc["question"]).otherwise(F.concat(acc["question"], more)).alias("question"),
            F.when(fits, F.concat(acc["options"], F.array(x["p"])))
            .when(n > 0, F.concat(head, F.array(F.concat(F.get(acc["options"], n - 1), more))))
            .otherwise(acc["options"])
            .alias("options"),
        )

    return F.aggregate(rows, empty, step)


def parse_exam(pages: DataFrame) -> DataFrame:
    """Questions of pages (document_id, page_number, text).

    Returns document_id, block, number, question, options (a map from A to E), answer (the inline one, else the key's),
    answer_text, explanation, confidence, status, page_number. A question never gets an answer that no text states.
    """
    blocks = question_blocks(pages)
    pattern = f"(?isu)^(.*?){rules.EXPLANATION}(.*)\\z"
    has = F.col("block_text").rlike(pattern)
    blocks = blocks.withColumn("explanation", F.when(has, text.strip(F.regexp_extract("block_text", pattern, 2))))
    blocks = blocks.withColumn("body", F.when(has, text.strip(F.regexp_extract("block_text", pattern, 1))).otherwise(F.col("block_text")))
    answer = f"(?iu){rules.INLINE_ANSWER}"
    inline = F.regexp_extract("body", answer, 1)
    blocks = blocks.withColumn("inline", F.when(inline != "", text.option_key(inline)))
    first = f"(?isu)^(.*?)(?:{rules.INLINE_ANSWER})"
    blocks = blocks.withColumn("body", F.when(F.col("inline").isNotNull(), text.strip(F.regexp_replace("body", first, "$1"))).otherwise(F.col("body")))
    blocks = blocks.withColumn("parts", options_of(F.col("body")))
    enough = F.size("parts.options") >= 2
    options = F.when(enough, F.transform("parts.options", clean_option)).otherwise(F.array().cast("array<string>"))
    letters = F.slice(F.split(F.lit(",".join(rules.OPTION_LETTERS)), ","), F.lit(1), F.size("option_list"))
    blocks = blocks.withColumn("option_list", options)
    blocks = blocks.withColumn("options", F.map_from_arrays(letters, F.col("option_list")))
    blocks = blocks.withColumn("question", clean_lines(F.when(enough, F.col("parts.question")).otherwise(F.col("body"))))
    whole = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
    keys = answer_keys(whole.select("document_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text")))
    keys = keys.select("document_id", "number", F.col("answer").alias("key_answer"))
    out = blocks.join(keys, ["document_id", "number"], "left").withColumn("answer", F.coalesce("inline", "key_answer"))
    n = F.size("option_list")
    known = F.col("answer").isNotNull()
    high = (n >= 4) & known & (F.coalesce(F.try_element_at("options", F.col("answer")), F.lit("")) != "")
    return out.select(
        "document_id", "block", "number",
        F.when(F.col("question") == "", F.concat(F.lit("Question "), F.col("number").cast("string"))).otherwise(F.col("question")).alias("question"),
        "options", "answer", F.try_element_at("options", F.col("answer")).alias("answer_text"), "explanation",
        F.when(high, "high").when((n >= 3) & known, "medium").otherwise("needs-review").alias("confidence"),
        F.when((n >= 3) & known, "answered").when(~known, "missing_answer").otherwise("needs_review").alias("status"),
        "page_number",
    )
