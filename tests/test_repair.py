"""Repair of photographed questions: screens, glued labels, answers in stems and overlapping pages."""

from pyspark.sql import functions as F

from quizlode.functions import cleanup
from quizlode.operators import repair

QUESTIONS = "document_id string, sequence int, id string, stem string, options array<struct<label:string,text:string>>"


def options(*texts):
    return [{"label": x.split(":", 1)[0], "text": x.split(":", 1)[1]} for x in texts]


def test_screens():
    assert repair.without_screen("Нерв, который иннервирует гортань & tests.site.by CJ] 09:41 3 ull 87 ($) = eee") == "Нерв, который иннервирует гортань"
    assert repair.without_screen("Смесь 2:15 готова") == "Смесь 2:15 готова"
    assert repair.without_screen("стенка + |глотки") == "стенка глотки"
    assert repair.without_screen(None) == "" and repair.without_screen("") == ""


def test_labels():
    shown = lambda found: [f"{o['label']}:{o['text']}" for o in found[1]]
    glued = repair.repaired("Что уже всего?", options("a:Переход в трахею е b. Голосовая щель", "c:Вход", "d:Преддверие « e. Карман"))
    assert shown(glued) == ["a:Переход в трахею", "b:Голосовая щель", "c:Вход", "d:Преддверие", "e:Карман"]
    inline = repair.repaired("С какой целью? v a. Купирование шока", options("b:Смещение |", "c:Асфиксия"))
    assert inline[0] == "С какой целью?" and shown(inline) == ["a:Купирование шока", "b:Смещение", "c:Асфиксия"]
    plain = repair.repaired("Что такое флегмона?", options("b:Второе", "a:Витамин D. первое"))
    assert shown(plain) == ["a:Витамин D. первое", "b:Второе"]
    assert repair.repaired(None, []) == ("", [])


def test_answers_in_stems(spark):
    rows = spark.createDataFrame([(1, "Трубка для операции называется канюля Люэра в ответе указать эпоним"), (2, "Какие фасции есть в этой области?")], "id int, stem string")
    found = {r.id: r.a for r in rows.select("id", cleanup.split_filled(F.col("stem")).alias("a")).collect()}
    assert "Люэра" in str(found[1]) and (found[2] is None or found[2].answer is None)


def test_overlapping_pages(spark):
    full = options("a:Псевдомембранозный процесс", "b:Фибринозный процесс тканей", "c:Ограниченный гнойный процесс")
    rows = [
        ("d", 1, "whole", "Самое узкое место полости гортани", options("a:Голосовая щель гортани", "b:Преддверие гортани", "c:Верно")),
        ("d", 2, "leaked", "Фасция задней поверхности ограничивает пространство", options("a:Преддверие гортани", "b:Верно", "c:Ещё одна фасция")),
        ("d", 3, "copy", "Что такое флегмона?", options("a:Псевдомембранозный")),
        ("d", 4, "full", "Что такое флегмона?", full),
        ("d", 5, "cut", "Укажите с какой целью", []),
        ("d", 6, "long", "Укажите, с какой целью производится блокада?", full[:2]),
        ("e", 1, "other", "Стенка трахеи замкнута", options("a:Верно", "b:Неверно")),
        ("e", 2, "next", "Артерия отдаёт ветви", options("a:Верно", "b:Неверно")),
    ]
    found = {r.id: [o.text for o in r.options] for r in repair.repair_sequence(spark.createDataFrame(rows, QUESTIONS)).collect()}
    assert set(found) == {"whole", "leaked", "full", "long", "other", "next"}
    assert found["leaked"] == ["Верно", "Ещё одна фасция"] and found["next"] == ["Верно", "Неверно"]
    assert repair.repair_sequence(spark.createDataFrame([], QUESTIONS)).count() == 0
    assert repair.repair(spark.createDataFrame([(None, None)], "stem string, options array<struct<label:string,text:string>>")).first().stem == ""


def test_sequences_carry_two_rows_and_no_trigrams(spark):
    """An option goes only while one of the two kept rows before has it, however long the document is, in one shuffle."""
    rows = [("d", i, f"q{i:04}", f"{i * 7919:x} quite other {i * 104729:x}", options("a:the shared option of all", f"b:own option {i}")) for i in range(3000)]
    asked = repair.repair_sequence(spark.createDataFrame(rows, QUESTIONS).repartition(3))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
    found = {r.id: len(r.options) for r in asked.collect()}
    assert len(found) == 3000 and all(n == (2 if int(k[1:]) % 3 == 0 else 1) for k, n in found.items())


def test_what_comes_is_seen_without_moving_it(spark):
    """Rows wait for the two after them, however the batches fall; nothing of a row is sent beside another one, and alike stems are looked for once asked."""
    import pyarrow as pa

    rows = [("d", "cut", "cut", []), ("d", "cut off", "cut off", []), ("d", "a b c", "a b c", []), ("d", "a b c d", "a b c d", ["the option of all", "one"]), ("d", "other", "other", ["the option of all"]), ("e", "a b c", "a b c", []), ("e", "x", "x", ["the option of all"])]
    schema = pa.schema([("document_id", pa.string()), ("_key", pa.string()), ("_head", pa.string()), ("_keys", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
    read = lambda n: [(r["document_id"], r["_places"]) for b in repair._in_order(batch.slice(k, n) for k in range(0, len(rows), n)) for r in b.to_pylist()]
    assert read(1) == read(2) == read(3) == read(100) == [("d", []), ("d", []), ("d", [0, 1]), ("d", []), ("e", []), ("e", [0])]
    asked = repair.repair_sequence(spark.createDataFrame([("d", 1, "q", "s", [])], QUESTIONS))
    assert "lead(" not in asked._jdf.queryExecution().executedPlan().toString() and [r.id for r in asked.collect()] == ["q"]


def test_keys_of_either_alphabet(spark):
    """A text is taken apart only where both alphabets are in it."""
    from quizlode.functions import text

    found = spark.createDataFrame([("Вoда\u00a0и\ufeff x", ), ("plain  (text) — «here»…", ), ("простo", ), ("a\u2003а", ), (None, )], "s string").select(text.match_key(F.col("s")).alias("k")).collect()
    assert [r.k for r in found] == ["вода и x", "plain text here", "просто", "а а", ""]
