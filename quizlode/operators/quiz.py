"""Building quizzes and grading answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text
from .bank import answer_keys


def canonical(x: Column) -> Column:
    """Typed text without case, punctuation, mixed alphabets, blanks and dashes."""
    return F.regexp_replace(text.fold_mixed_words(text.yo(text.answer_key_text(x))), r"[\s\-–—]+", "")


def as_number(x: Column) -> Column:
    bare = F.trim(x)
    return F.when(bare.rlike(r"^-?[0-9]+(?:[.,][0-9]+)?$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))


def text_matches(typed: Column, expected: Column) -> Column:
    """Equal as numbers, else equal in canonical form, else within an edit for each six letters."""
    a, b = as_number(typed), as_number(expected)
    x, y = canonical(typed), canonical(expected)
    near = (x == y) | (F.levenshtein(x, y) <= F.floor(F.length(y) / 6))
    return F.coalesce(F.when(x == "", F.lit(False)).when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-9).otherwise(near), F.lit(False))


def choice_right(picked: Column, key: Column) -> Column:
    """Whether the picked keys are exactly the right ones."""
    right = F.array_sort(F.array_distinct(answer_keys(key)))
    return (F.size(right) > 0) & (F.array_sort(F.array_distinct(picked)) == right)


def grade(answers: DataFrame, by: str) -> DataFrame:
    """(by, n, right, percent) of graded answers (by, is_right)."""
    out = answers.groupBy(by).agg(F.count("*").alias("n"), F.count_if("is_right").alias("right"))
    return out.withColumn("percent", F.floor(100 * F.col("right") / F.col("n") + 0.5).cast("long"))


_BLANK = re.compile(r"_{2,}|…{2,}|\.{4,}")
_QUOTED = re.compile("«([^»]+)»|\"([^\"]+)\"|“([^”]+)”")
_MARKS = "«»\"“”„"


def _bare(word: str) -> str:
    return word.strip(" \t\n" + _MARKS + "'").rstrip(".,;:!? ")


def _aligned(stem: str, answer: str) -> list[str]:
    """The words that stand in a full sentence where the stem has blanks."""
    loose = [r"\s+".join(map(re.escape, re.sub(f"[{_MARKS}]", "", part).split())) for part in _BLANK.split(stem)]
    between = "(.+?)".join([loose[0] + r"\s*", *(rf"\s*{part}\s*" if part else r"\s+" for part in loose[1:-1]), r"\s*" + loose[-1]])
    pattern = rf"\s*{between}[\s.,;:!?]*"
    found = re.fullmatch(pattern, re.sub(f"[{_MARKS}]", "", answer).strip(), re.IGNORECASE | re.DOTALL)
    words = [_bare(w) for w in found.groups()] if found else []
    return words if all(words) else []


def blank_words(stem: str | None, answer: str | None) -> list[str] | None:
    """The expected word of every blank of a stem: quoted ones, those of a full sentence, listed ones, or the only one."""
    blanks = len(_BLANK.findall(stem or ""))
    if not blanks or not (answer or "").strip():
        return None
    quoted = [next(g for g in m if g).strip() for m in _QUOTED.findall(answer)]
    listed = [w for w in map(_bare, re.split(r"\s*[;,]\s*", answer)) if w]
    for words in (quoted, _aligned(stem, answer), listed):
        if len(words) == blanks:
            return words
    return [_bare(answer)] if blanks == 1 and not quoted else None


@F.pandas_udf(ArrayType(StringType()))
def blank_answers(stem: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([blank_words(s, a) for s, a in zip(stem, answer, strict=True)])


def blanks_right(typed: Column, expected: Column) -> Column:
    """Whether every typed word matches the one expected at its place; missing words do not."""
    pairs = F.zip_with(typed, expected, lambda t, e: text_matches(F.coalesce(t, F.lit("")), F.coalesce(e, F.lit(""))))
    return (F.size(typed) <= F.size(expected)) & F.forall(pairs, lambda ok: ok)


def slots_right(placed: Column, expected: Column) -> Column:
    """Whether a map from options to places is the expected one."""
    sort = lambda m: F.array_sort(F.map_entries(m))
    return F.coalesce(sort(placed) == sort(expected), F.lit(False))
