"""Cleaning of photographed and exported texts."""

import pytest
from pyspark.sql import functions as F

from quizlode.functions import cleanup


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (cleanup.strip_score_noise, "Функция печени Балл: 1,00 из 1,00 Отметить вопрос", "Функция печени"),
        (cleanup.strip_score_noise, "6алл 2 of 3 Which one?", "Which one?"),
        (cleanup.strip_platform, "Строение сердца lms.example.org/x 12:30 15 LTE 80 | @ Flag question", "Строение сердца"),
        (cleanup.is_ocr_garbage, "погода 12 °C", True),
        (cleanup.is_ocr_garbage, "Какие клетки участвуют в гемостазе?", False),
        (cleanup.is_ocr_garbage, "нервы ErEE bun %% ## головы", True),
        (cleanup.is_unreadable, "1. 2. нервы 3. нерв", True),
        (cleanup.is_unreadable, "Какие клетки участвуют в гемостазе?", False),
        (cleanup.is_unreadable, None, True),
        (cleanup.is_heading, "Топографическая анатомия", True),
        (cleanup.is_heading, "Сердце качает кровь", False),
        (cleanup.is_heading, "Строение ДНК", False),
        (cleanup.wrap, "one two three", ["one two three"]),
        (lambda x: cleanup.wrap(x, 8), "one two three extraordinary", ["one two", "three", "extraordinary"]),
        (cleanup.wrap, "", []),
    ],
)
def test_cleanup(spark, f, given, wanted):
    assert spark.createDataFrame([(given,)], "x string").select(f(F.col("x"))).first()[0] == wanted


def test_filled_answers(spark):
    rows = spark.createDataFrame([("Какой нерв парный и смешанный? блуждающий нерв (название нерва)",), ("Какой нерв парный?",), (None,)], "x string")
    found = [r[0] for r in rows.select(cleanup.split_filled(F.col("x"))).collect()]
    assert (found[0].stem, found[0].answer) == ("Какой нерв парный и смешанный? _____ (название нерва)", "Блуждающий нерв")
    assert found[1:] == [None, None]
