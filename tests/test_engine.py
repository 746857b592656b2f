"""The document engine on hand-written exports."""

import pytest
from pyspark.sql import functions as F

from quizlode.operators import engine

CHECK, CROSS = "", ""


def page(number, lines):
    """Lines (text, side, right) from the top; a footer on every page."""
    items, y = [], 40.0
    for line in lines:
        text, side, right = (*line, None, None)[:3] if isinstance(line, tuple) else (line, None, None)
        if side:
            items.append({"str": side, "x": 30.0, "y": y, "w": 4.0 * len(side), "h": 11.0})
        items.append({"str": text, "x": 160.0, "y": y, "w": 5.2 * len(text), "h": 11.0})
        if right:
            items.append({"str": right, "x": 520.0, "y": y, "w": 8.0, "h": 11.0})
        y += 16
    items.append({"str": "https://lms.example.org/mod/quiz/review.php?attempt=1", "x": 40.0, "y": 800.0, "w": 250.0, "h": 9.0})
    return number, items


def exported():
    def question(n, stem, state, score, options, several=False):
        first = (stem, f"Вопрос {n}")
        second = ("Выберите один или несколько ответов:" if several else "Выберите один ответ:", state)
        lines = [first, second]
        for i, (text, mark) in enumerate(options):
            lines.append((f"{'abcd'[i]}. {text}", f"Баллов: {score} из 1,00" if i == 0 else None, mark))
        return lines

    head = lambda day: [f"Тест начат {day} октября 2024, 10:00", "Состояние Завершено", "Баллы 3,50/5,00"]
    blood, cells, red = "Белки плазмы, от которых зависит агрегатное состояние крови:", "Какие клетки участвуют в гемостазе?", "Главная функция эритроцитов:"
    return [
        page(1, ["Нормальная физиология", *head(3), *question(1, blood, "Верно", "1,00", [("альбумины", None), ("фибриноген", CHECK), ("глобулины", None)]),
                 *question(2, cells, "Частично правильный", "0,50", [("тромбоциты", CHECK), ("эритроциты", None), ("эндотелиоциты", None)], True),
                 *question(3, red, "Неверно", "0,00", [("транспорт газов", None), ("фагоцитоз", CROSS), ("выработка антител", None)])]),
        page(2, question(4, "Содержание гемоглобина у здоровых мужчин", "Верно", "1,00", [("130 г/л", CHECK), ("90 г/л", None)])),
        page(3, ["c. 250 г/л", *head(4), *question(1, blood, "Верно", "1,00", [("глобулины", None), ("альбумины", None), ("фибриноген", CHECK)]),
                 *question(2, cells, "Верно", "1,00", [("эритроциты", None), ("тромбоциты", CHECK), ("эндотелиоциты", CHECK)], True),
                 *question(3, red, "Верно", "1,00", [("фагоцитоз", None), ("транспорт газов", CHECK), ("выработка антител", None)])]),
    ]


def pages_of(spark, pages):
    return spark.createDataFrame([("doc", n, items) for n, items in pages], engine.PAGE)


@pytest.fixture(scope="module")
def analyzed(spark):
    return engine.analyze(pages_of(spark, exported())).orderBy("sequence").collect()


def test_two_attempts(analyzed):
    assert [(r.attempt, r.number) for r in analyzed] == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3)]
    assert analyzed[0].stem == "Белки плазмы, от которых зависит агрегатное состояние крови:"
    assert [o.text for o in analyzed[3].options] == ["130 г/л", "90 г/л", "250 г/л"]  # over the page break


def test_marks_scores_and_learned_icons(analyzed):
    right = [[r.options[i].text for i in r.right] for r in analyzed]
    assert right == [["фибриноген"], ["тромбоциты"], [], ["130 г/л"], ["фибриноген"], ["тромбоциты", "эндотелиоциты"], ["транспорт газов"]]
    assert [r.status for r in analyzed] == ["CONFIRMED_BY_SCORE", "NEEDS_REVIEW", "UNRESOLVED", *["CONFIRMED_BY_SCORE"] * 4]
    assert [r.score_kind for r in analyzed[:3]] == ["FULL_SCORE", "PARTIAL_SCORE", "ZERO_SCORE"]


def test_footers_are_noise(spark):
    roles = engine.classify(engine.build_lines(pages_of(spark, exported()))).groupBy("role").agg(F.count("*").alias("n")).collect()
    assert {r.role: r.n for r in roles}["NOISE"] == 3


def test_signs_and_headerless_questions(spark):
    lines = ["Какие ионы нужны для свёртывания крови?", "+{00} ионы кальция", "-{00} ионы натрия", "Выберите все форменные элементы крови:", "+{00} эритроциты", "+{00} тромбоциты", "-{00} фибробласты"]
    rows = engine.analyze(pages_of(spark, [page(1, lines)])).orderBy("sequence").collect()
    assert [(r.status, r.confidence) for r in rows] == [("CONFIRMED_BY_DOCUMENT", 0.97)] * 2
    assert [r.type for r in rows] == ["SINGLE_CHOICE", "MULTIPLE_CHOICE"]
    assert [o.text for o in rows[1].options] == ["эритроциты", "тромбоциты", "фибробласты"]


def test_numbered_questions_with_feedback_and_order(spark):
    lines = ["1. Which vessel carries blood to the heart?", "a. artery", "b. vein", "The correct answer is: vein", "2. Put the phases in order:", "[02] second phase", "[01] first phase", "3. What is left open?", "a. this", "b. that"]
    rows = engine.analyze(pages_of(spark, [page(1, lines)])).orderBy("sequence").collect()
    assert [r.number for r in rows] == [1, 2, 3]
    assert [rows[0].options[i].text for i in rows[0].right] == ["vein"] and rows[0].status == "CONFIRMED_BY_DOCUMENT"
    assert list(rows[1].right_order) == [1, 0]
    assert rows[2].status == "UNRESOLVED" and not rows[2].right


def test_empty_document(spark):
    assert engine.analyze(spark.createDataFrame([], engine.PAGE)).count() == 0


def test_feedback_answers(spark):
    """A feedback line names options (the others are wrong), links pairs, answers a question without options, or fits none."""
    lines = [("Что переносит кислород?", "Вопрос 1"), "Выберите один ответ:", "a. эритроциты крови", "b. эритроциты", "c. лимфоциты", "Правильный ответ: Эритроциты крови",
             ("Установите соответствие органов", "Вопрос 2"), "Выберите один ответ:", "a. сердце", "b. лёгкое", "Правильный ответ: сердце → насос, лёгкое → газообмен",
             ("Назовите канюлю для операции", "Вопрос 3"), "Правильный ответ: канюля Люэра",
             ("Какой ответ верен здесь?", "Вопрос 4"), "Выберите один ответ:", "a. первый", "b. второй", "Правильный ответ: совсем другое"]
    found = engine.analyze(pages_of(spark, [page(1, lines)])).orderBy("number").collect()
    assert [(r.right, r.wrong, r.matching, r.text_answer) for r in found] == [
        ([0], [1, 2], None, None), ([], [], {"сердце": "насос", "лёгкое": "газообмен"}, None), ([], [], None, "канюля Люэра"), ([], [], None, "совсем другое"),
    ]
    assert [(r.status, r.confidence, r.type) for r in found][:3] == [("CONFIRMED_BY_DOCUMENT", 0.97, "SINGLE_CHOICE"), ("CONFIRMED_BY_DOCUMENT", 0.95, "MATCHING"), ("CONFIRMED_BY_DOCUMENT", 0.93, "SINGLE_CHOICE")]
    assert found[3].status == "UNRESOLVED" and found[3].issues == ["FEEDBACK_UNMATCHED"] and [r.extraction_status for r in found] == ["PARSED", "PARSED", "PARSED", "NEEDS_REVIEW"]
