"""Types and subjects of single questions."""

from quizlode.operators import layout


def test_subject_hints(spark):
    rows = spark.createDataFrame([(1, "Артерия и вена плеча, нерв"), (2, "Fermentation"), (3, None), (4, "Эпителий и ткань, артерии мышц")], "id int, text string")
    assert {r.id: list(r.hints) for r in layout.subject_hints(rows).collect()} == {1: ["anatomy"], 2: [], 3: [], 4: ["anatomy", "histology"]}


def test_source_types(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 5, 4, 2, 0, 3, 0), (2, 5, 4, 0, 0, 3, 0), (3, 0, 0, 0, 6, 1, 0), (4, 3, 0, 0, 0, 2, 0), (5, 0, 0, 0, 0, 2, 0), (6, 9, 9, 9, 9, 10, 7)], "id int, h int, s int, m int, g int, p int, o int")
    kinds = [r[0] for r in rows.orderBy("id").select(layout.source_type(*[F.col(c) for c in "hsmgpo"])).collect()]
    assert kinds == ["MOODLE_EXPORT", "LMS_EXPORT", "PLUS_MINUS_BANK", "NUMBERED_LIST", "UNKNOWN", "SCANNED"]


def test_coverage_needs_no_join_and_keeps_missing_keys_apart(spark):
    kind = "document_id int, number int"
    expected = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None), (2, 1), (None, 5)], kind)
    found = layout.coverage(spark.createDataFrame([(1, 1), (1, None), (1, 9), (3, 1), (None, 5)], kind), expected)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows == [(1, 3, 3, 2, False), (2, 1, 0, 1, False), (3, 0, 1, 0, False), (None, 1, 1, 1, False)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
