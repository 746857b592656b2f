"""Text scalars with scripts that the test tables lack, grading, files and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quizlode.functions import similarity, text
from quizlode.operators import bank, evidence, exam, export, quiz, resolve
from quizlode.sources import csv_bank
from quizlode.streaming import pages as streaming


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    types = {str: "string", int: "int", float: "double", list: "array<string>", type(None): "string"}
    row = spark.createDataFrame([values], ", ".join(f"{n} {types[type(v)]}" for n, v in zip(names, values)))
    return row.select(f(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (text.dedupe_key, "  Ёлка, «Дом»-2! ", "елка дом 2"),
        (text.match_key, "✓ Трaхея (левая) – Th1", "трахея левая th1"),
        (text.option_key, "খ)", "B"),
        (text.option_key, "(৩)", "C"),
        (text.option_key, "d.", "D"),
        (text.option_key, "7", "7"),
        (text.bengali_to_digits, "১২৩", "123"),
        (text.locale_number, "1,50", 1.5),
        (text.locale_number, "", 0.0),
        (text.locale_number, "abc", None),
        (text.to_latex, "10⁻³ ≤ α", "10^{-3} \\le \\alpha"),
        (text.to_latex, "plain", None),
        (text.blanks, "a □□ b ____ ___ c", "a _____ b _____ c"),
        (text.noise_key, "Page 12  of 40", "page # of #"),
        (text.is_noise_line, "পৃষ্ঠা ১২", True),
        (text.is_noise_line, "A question?", False),
        (text.strip_markup, "<p>a &amp; b</p> c", "a & b c"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_languages(spark):
    assert one(spark, text.languages, "Привіт, світ") == ["uk"]
    assert one(spark, text.languages, "Привет world, мир") == ["ru", "en"]
    assert one(spark, text.languages, "বাংলা") == ["bn"]


def test_similarity(spark):
    assert one(spark, similarity.hamming, "ff0", "0f1") == 5
    assert one(spark, similarity.hamming, "ff", "fff") is None
    assert one(spark, similarity.blocking_keys, "the longest words of the question here") == ["question", "longest", "words", "here"]
    assert one(spark, similarity.blocking_keys, "a b c") == ["a b c"]
    assert one(spark, similarity.jaccard, ["a"], ["a", "b"]) == 0.5


def test_grading(spark):
    assert one(spark, quiz.text_matches, "Печенъ", "печень") is True
    assert one(spark, quiz.text_matches, "0,5", "0.50") is True
    assert one(spark, quiz.text_matches, "", "x") is False
    assert one(spark, quiz.choice_right, ["C", "A"], "A; C") is True
    assert one(spark, quiz.choice_right, ["A"], "A,C") is False


def test_solve_by_score(spark):
    assert one(spark, evidence.solve_by_score, 3, 1, 1.0) == 1
    assert one(spark, evidence.solve_by_score, 4, 3, 0.5) is None  # several sets fit


def test_answers_are_never_invented(spark):
    pages = spark.createDataFrame([(1, 1, "1. First?\nA) x\nB) y\nC) z\nIn 1952-B it was so.\n2. Second?\nA) p\nB) q\nC) r\nD) s\nAns: (b)\nExplanation: because")], "document_id int, page_number int, text string")
    rows = exam.parse_exam(pages).orderBy("number").collect()
    assert [(r.number, r.answer, r.status) for r in rows] == [(1, None, "missing_answer"), (2, "B", "answered")]
    assert rows[1].explanation == "because" and rows[1].options["D"] == "s"


def questions(spark):
    return spark.createDataFrame([(1, 1, 'Say "x"?', {"A": "1", "B": "<2>"}, "A"), (2, 2, "Two,\r\nlines", {"A": "a", "B": "b", "E": "e"}, None)], "id int, number int, question string, options map<string,string>, answer string").withColumn("confidence", F.lit("high")).withColumn("page", F.lit(3))


def test_csv_contract_and_round_trip(spark, tmp_path):
    path = tmp_path / "bank.csv"
    assert export.write_csv(questions(spark), str(path)) == 2
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\r\n") == 2 and not raw.endswith(b"\n")
    back = csv_bank.import_report(csv_bank.read_csv(spark, str(path))).orderBy("id").collect()
    assert [(r.question, r.option_b, r.answer, r.reason) for r in back] == [('Say "x"?', "<2>", "A", None), ("Two,\nlines", "b", None, "missing answer")]


def test_archives(spark, tmp_path):
    assert export.write_svg_zip(questions(spark), str(tmp_path / "a.zip")) == 2
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.namelist() == ["Question-001.svg", "Question-002.svg"]
        svg = z.read("Question-001.svg").decode()
        assert "question-section" in svg and "answer-section" in svg and "&lt;2&gt;" in svg
    assert export.write_sheet(questions(spark).select("id", "question"), str(tmp_path / "b.xlsx")) == 2
    assert export.write_text(questions(spark), str(tmp_path / "c.txt")) == 2


def test_merge_and_locks(spark):
    old = spark.createDataFrame([(1, True, "s1", "A"), (2, False, "s2", "B")], "id int, is_manual boolean, stem string, answer string")
    new = spark.createDataFrame([(1, "n1", "C"), (2, "n2", "C"), (3, "n3", "D")], "id int, stem string, answer string")
    rows = bank.write_canonicals(old, new, ["answer"]).orderBy("id").collect()
    assert [(r.stem, r.answer) for r in rows] == [("n1", "A"), ("n2", "C"), ("n3", "D")]


def test_generic_stems_do_not_merge(spark):
    rows = spark.createDataFrame([(1, "What does number 17 show?", ["a", "b"]), (2, "What does number 17 show?", ["c", "d"]), (3, "What does number 17 show?", ["b", "a"])], "id int, stem string, options array<string>")
    rows = rows.withColumn("key", text.match_key(F.col("stem"))).withColumn("type", F.lit("SINGLE_CHOICE"))
    found = {(r.a_id, r.b_id): r.auto_merge for r in resolve.matches(rows, rows).collect()}
    assert found == {(1, 2): False, (1, 3): True, (2, 3): False}


def test_page_stream(spark, tmp_path):
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for version in (1, 2):
        rows = spark.createDataFrame([(1, 1, f"v{version}", version), (1, version, "x", version)], streaming.PAGES).dropDuplicates(["document_id", "page_number"])
        rows.write.mode("append").json(folder)
        streaming.stream_pages(spark, folder, target, checkpoint).awaitTermination()
    latest = {(r.document_id, r.page_number): r.version for r in streaming.latest_pages(spark, target).collect()}
    assert latest == {(1, 1): 2, (1, 2): 2}


def test_pages_are_sanitized(spark):
    from quizlode.operators import records

    rows = spark.createDataFrame([("d", 1, None, 10.0, [("x" * 3000, 1.0, None, 2.0, 3.0), ("", 0.0, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0, 0.0)]), ("d", 0, 1.0, 1.0, [])], "document_id string, page int, width double, height double, items array<struct<str:string,x:double,y:double,w:double,h:double>>")
    (row,) = records.sanitize_pages(rows).collect()
    assert (row.page, row.width, row.height) == (1, 595.0, 10.0)
    assert len(row["items"]) == 1 and len(row["items"][0].str) == 2000 and row["items"][0].y == 0.0


def test_blanks(spark):
    rows = spark.createDataFrame(
        [("The ___ pumps ____ through vessels", "The heart pumps «red» blood through vessels"), ("A ___ and a ___", "vein; artery"), ("One ___", "\"liver\""), ("None", "x"), ("___ ___", "one"), (None, None)], "s string, a string"
    )
    found = [r[0] for r in rows.select(quiz.blank_answers("s", "a")).collect()]
    assert found == [["heart", "red blood"], ["vein", "artery"], ["liver"], None, None, None]
    graded = spark.createDataFrame([(["Hart", "red blood"], ["heart", "red blood"]), (["heart"], ["heart", "blood"]), (["VEIN", "artery"], ["vein", "artery"])], "t array<string>, e array<string>")
    assert [r[0] for r in graded.select(quiz.blanks_right(F.col("t"), F.col("e"))).collect()] == [False, False, True]


def test_json_envelope(spark, tmp_path):
    import json

    assert export.write_json(questions(spark), str(tmp_path / "q.json")) == 2
    held = json.loads((tmp_path / "q.json").read_text())
    assert held["totalQuestions"] == 2 and held["questions"][1]["correctAnswer"] is None and held["questions"][0]["pageNumber"] == 3


def test_blank_pictures_work_their_shades_out_once(spark):
    fine = ["", None, "0" * 64, "7" * 63 + "9", "7" * 399 + "9", "7" * 64 + "89" * 5, "F" * 32 + "f" * 32]
    rows = spark.createDataFrame(list(enumerate(fine)), "id long, fine string").select("id", text.is_blank_picture(F.col("fine")).alias("blank"))
    assert [r.blank for r in rows.orderBy("id").collect()] == [False, False, True, False, True, False, True]
    assert rows._jdf.queryExecution().analyzed().toString().count("conv(") == 1
