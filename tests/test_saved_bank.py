"""Saved banks of both shapes, and the log of stages."""

import json

from pyspark.sql import functions as F

from quizlode.operators import compose, engine
from quizlode.sources import saved_bank
from quizlode.sources.stages import StageLog
from tests.test_engine import exported, pages_of


def test_both_shapes(spark, tmp_path):
    bank = [
        {"id": "1", "number": "7a", "question": "Что переносит кислород? Балл: 1,00", "options": {"B": "лимфоциты", "A": "эритроциты Балл: 0,50"}, "correctAnswer": "A", "confidence": "high"},
        {"id": "2", "questionNumber": 3, "question": {"text": "Is it so?"}, "options": [{"key": "A", "text": "yes"}], "answer": None, "confidence": {"overall": 0.7, "level": "medium"}, "status": "review", "source": {"documentId": "d", "pageNumber": 4}},
        {"id": "3", "number": "x", "question": "Short", "options": {}, "correctAnswer": None, "answerText": "typed", "confidence": "medium", "tags": ["t"], "pageNumber": 9},
        {"number": 1, "question": "without an id", "options": {}},
    ]
    (tmp_path / "bank.json").write_text(json.dumps(bank, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("[]")
    found = {r.id: r for r in saved_bank.load(spark, str(tmp_path)).collect()}
    assert set(found) == {"1", "2", "3"}
    one, two, three = (found[i] for i in "123")
    assert (one.number, one.question, [tuple(o) for o in one.options], tuple(one.answer), one.status) == (7, "Что переносит кислород?", [("A", "эритроциты"), ("B", "лимфоциты")], ("A", "эритроциты"), "verified")
    assert (two.number, two.question, two.answer, two.confidence.overall, two.status, two.document_id, two.page) == (3, "Is it so?", None, 0.7, "review", "d", 4)
    assert (three.number, tuple(three.answer), three.status, three.tags, three.page, three.category) == (1, ("", "typed"), "pending", ["t"], 9, "General")


def test_stages_of_a_bank(spark, tmp_path):
    log = StageLog()
    compose.build(engine.analyze(pages_of(spark, exported())), str(tmp_path), log).collect()
    rows = log.table(spark).orderBy("place").collect()
    assert [r.stage for r in rows] == ["instances", "members", "questions"] and rows[0].rows == rows[1].rows == 7 and all(r.ms >= 0 for r in rows)
    own = StageLog()
    own.kept(spark.range(5), str(tmp_path / "r"), "numbers", total=F.sum("id"))
    assert own.stages[0][0] == "numbers" and own.stages[0][2:] == (5, {"total": "10"})
