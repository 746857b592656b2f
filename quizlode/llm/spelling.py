"""Spelling variants by an even-partition pigeonhole join.

Two words one edit apart share a half: a word of some length is divided into two segments, and whoever is one edit away
(equally long, or one longer) has one of them unchanged, at its place or shifted by the letter that is more. Every word
is indexed under both of its segments, and looked up, as the equal or longer word of a pair, under the substrings that
such segments would be.

A short segment is common to a large share of all words. Its pairs are not made: the other half of the word holds the
edit, so the same argument holds for that half, and one of its two segments is unchanged as well. Keys are therefore a
segment with a segment of what remains, in the index and in the look-up alike. What meets is verified by its edit
distance, and pairs that met under several keys are made one.

Counting words is one aggregation with partial sums; the tables after it hold distinct words, so they grow with the
vocabulary. Forms are followed to their roots by doubling: chains are short, as every step is to a word ten times as
frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, lower_ascii, table

#: Letters of a word, its fewest letters and occurrences, and by how much a form is more frequent.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs loses a letter (see ``damaged``).
DAMAGE = 31


def damaged(run: Column, doc_id: Column, one_in: int = DAMAGE) -> Column:
    """The run, without the letter that its hash with the document names, where ``one_in`` divides that hash (no id: no hash)."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int | None = DAMAGE) -> DataFrame:
    """(word, n): the distinct words of whole texts and how often they occur."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"([{LETTERS}]{{{least_letters},}})"), F.lit(1))
    rows = docs.select(F.col("doc_id"), F.explode(runs).alias("run"))
    run = lower_ascii(F.col("run"))
    word = damaged(run, F.col("doc_id"), one_in) if one_in else run
    return rows.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, start + 1, size)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _refined(rest: Column, size: Column, more: int) -> list[Column]:
    """The two segments of a rest whose indexed length is ``size``; the rest at hand is longer by ``more``."""
    first = _half(size)
    return [_part(rest, F.lit(0), first), _part(rest, first + more, size - first)]


def _keys(word: Column, more: int) -> Column:
    """Keys (length, segment, its letters, segment of the rest, its letters) of an indexed word (more = 0), or those
    under which a word looks for others that are shorter by ``more``."""
    length = F.length(word) - more
    first = _half(length)
    second = length - first
    keys = []
    # the first segment is whole, and the edit is in what follows; or the second is whole, at the end
    for number, segment, rest, size in (
        (0, _part(word, F.lit(0), first), _part(word, first, second + more), second),
        (1, _part(word, first + more, second), _part(word, F.lit(0), first + more), first),
    ):
        for inner, letters in enumerate(_refined(rest, size, more)):
            keys.append(F.struct(length.alias("length"), F.lit(number).alias("segment"), segment.alias("letters"), F.lit(inner).alias("inner"), letters.alias("rest")))
    return F.array(*keys)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the pairs of ``words`` (word) that one inserted, deleted or replaced code point makes equal, both ways."""
    index = words.select(F.col("word").alias("a"), F.explode(_keys(F.col("word"), 0)).alias("key"))
    equal = words.select(F.col("word").alias("b"), F.explode(_keys(F.col("word"), 0)).alias("key"))
    longer = words.select(F.col("word").alias("b"), F.explode(_keys(F.col("word"), 1)).alias("key"))
    met = index.join(equal, "key").where("a < b").unionByName(index.join(longer, "key"))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): where following forms ends. Each round doubles the steps."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = now.join(onward, F.col("root") == F.col("_word"), "left")
        last, now = now, cut(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        forget(last)
        moved, now_ = not now.where("moved").isEmpty(), now
        now = now.drop("moved")
        if not moved:
            return now
        now = cut(now, "roots")
        forget(now_)


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, one_in: int | None = DAMAGE) -> DataFrame:
    """One row for each word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A word is a maximal run of LETTERS (A-Z in lower case) of ``least_letters`` code points that occurs ``least_count``
    times in all texts; of one in ``one_in`` runs, told by a hash of document and run, a letter is deleted before words
    are counted (None: of no run). Words are near if one code point inserted, deleted or replaced makes them equal.
    form is the most frequent near word (ties: the smallest by code points) if it is ``times`` as frequent, else null;
    root is where forms lead, the word itself without one; n_near counts near words.

    A null text has no words, and a row without a doc_id has its words undamaged; rows that repeat count each. An empty
    table, or one without such words, gives no rows; other columns are ignored.
    """
    words = cut(word_counts(docs, least_letters, least_count, one_in), "words")
    near = near_words(words.select("word"))
    counted = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    # the largest count first, then the smallest word: one struct's minimum
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= times * F.col("n")
    found = found.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n"))
    found = cut(found, "forms")
    forget(words)
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: words of seven letters and more."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
