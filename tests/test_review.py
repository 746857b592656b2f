"""Attempt reviews, figures and composition at the edges."""

import random

from pyspark.sql import functions as F

from quizlode.operators import compose, figures, records, review, store, views

PAGES = "document_id string, page int, items array<struct<str:string,x:double,y:double,w:double,h:double>>"


def item(text, x, y):
    return {"str": text, "x": float(x), "y": float(y), "w": 40.0, "h": 10.0}


def test_no_review_gives_nothing(spark):
    pages = spark.createDataFrame([("d", 1, [item("Вопрос", 20, 10), item("1", 60, 10), item("text", 20, 30)]), ("e", 1, [])], PAGES)
    assert review.extract(pages).count() == 0
    assert review.extract(spark.createDataFrame([], PAGES)).count() == 0
    assert figures.figures(spark.createDataFrame([], PAGES)).count() == 0 and figures.slide_figures(pages.withColumn("items", F.transform("items", lambda i: i.withField("conf", F.lit(1.0))))).count() == 0


def test_attempts_that_disagree(spark):
    """Two full scores with other picks need review; marks of a partial score alone tell what is known."""
    def page(n, chosen, score):
        boxes = [("■" if c == chosen else "□", c) for c in "abc"]
        head = [item("Вопрос", 20, 10), item("5", 60, 10), item(f"Баллов: {score} из 1,00", 20, 30), item("Which one is it?", 20, 50), item("Выберите один ответ:", 20, 70)]
        return ("d", n, head + [x for k, (box, c) in enumerate(boxes) for x in (item(box, 20, 90 + 20 * k), item(f"{c}. option {c}", 40, 90 + 20 * k))])

    two = review.extract(spark.createDataFrame([page(1, "a", "1,00"), page(2, "b", "1,00"), page(3, "b", "1,00")], PAGES)).collect()
    assert [(r.answer, r.status, r.attempts) for r in two] == [("1", "needs_review", 3)]
    zero = review.extract(spark.createDataFrame([page(1, "a", "0,00"), page(2, "b", "0,00"), page(3, "a", "0,00")], PAGES)).collect()
    assert [(r.answer, r.status) for r in zero] == [("2", "answered")]


def test_pairs_and_orders(spark):
    """Ticked rows are known, the last free one follows, and a second attempt adds what the first does not know."""
    def page(n, marks, values, score, stem="Match the parts"):
        head = [item("Вопрос", 20, 10), item(str(n), 60, 10), item(f"Баллов: {score} из 3,00", 20, 30), item(stem, 20, 50)]
        rows = [item(x, 20 + dx, 70 + 20 * k) for k, (t, v, m) in enumerate(zip(("artery", "vein", "nerve"), values, marks)) for dx, x in ((0, t), (90, f"⟪{v}⟫"), (150, m)) if x]
        return ("d", n, head + rows)

    ok, no = "\u0019", "\u001a"
    pages = [page(1, (ok, no, ""), ("red", "white", "blue"), "1,00"), page(2, ("", "", ""), ("red", "blue", "white"), "1,00"), page(3, (no, "", ok), ("blue", "red", "white"), "1,00")]
    found = review.extract(spark.createDataFrame(pages, PAGES)).collect()
    assert [(r.kind, r.stem, r.answer, r.status, r.attempts) for r in found] == [("match", "Match the parts", "artery → red; vein → blue; nerve → white", "answered", 3)]
    orders = [page(k, ("", "", ""), ("[02]", "[01]", "[03]"), "3,00", "Put in order") for k in (1, 2, 3)]
    found = review.extract(spark.createDataFrame(orders, PAGES)).collect()
    assert [(r.kind, r.answer, r.status) for r in found] == [("order", "artery → [02]; vein → [01]; nerve → [03]", "answered")]


def test_blanks_inside_a_sentence(spark):
    pages = [("d", k, [item("Вопрос", 20, 10), item("4", 60, 10), item("Баллов: 1,00 из 1,00", 20, 30), item("The", 20, 50), item("⟪heart⟫", 50, 50), item("beats", 120, 50)]) for k in (1, 2, 3)]
    found = review.extract(spark.createDataFrame(pages, PAGES)).collect()
    assert [(r.kind, r.stem, r.answer, r.status) for r in found] == [("text", "The ___ beats", "heart", "answered")]


def test_attempts_are_read_once(spark):
    """What resolves them reads a table, not the reader of whole documents again and again."""
    pages = [("d", k, [item("Вопрос", 20, 10), item("4", 60, 10), item("Баллов: 1,00 из 1,00", 20, 30), item("The", 20, 50), item("⟪heart⟫", 50, 50), item("beats", 120, 50)]) for k in (1, 2, 3)]
    found = review.extract(spark.createDataFrame(pages, PAGES))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString() and found.count() == 1


def test_filled_copies_and_empty_tables(spark):
    rows = [(1, "Blood flows through the ___ to the lung", {}, "answered"), (2, "Blood flows through the right side to the lung", {}, "missing_answer"), (3, "Blood flows back", {}, "missing_answer")]
    schema = "id int, question string, options map<string,string>, status string"
    assert [r.id for r in compose.filled_copies(spark.createDataFrame(rows, schema)).collect()] == [2]
    assert compose.filled_copies(spark.createDataFrame([], schema)).count() == 0
    assert records.parse_answers(spark.createDataFrame([(1, "no json"), (2, None), (3, "[]")], "id int, json string")).count() == 0


def test_filled_copies_by_their_rarest_neighbours(spark):
    """Against all pairs, on few words; and many questions with one beginning meet only what shares more with them."""
    rnd = random.Random(5)
    some = lambda n: [rnd.choice("abcdefg") for _ in range(n)]
    texts = [some(rnd.randint(1, 7)) for _ in range(120)]
    for _ in range(80):
        w = list(rnd.choice(texts))
        for _ in range(rnd.randint(1, 8)):
            w.insert(rnd.randint(0, len(w)), rnd.choice("abcdefg"))
        texts.append(w)
    rows = [(k, " ".join(w), {}, "missing_answer" if k % 3 else "answered") for k, w in enumerate(texts)]

    def repeats(w, short):
        at = iter(w)
        return len(short) >= 3 and 1 <= len(w) - len(short) <= 6 and all(x in at for x in short)

    schema = "id int, question string, options map<string,string>, status string"
    want = {k for k, w in enumerate(texts) if k % 3 and any(repeats(w, x) for x in texts)}
    assert {r.id for r in compose.filled_copies(spark.createDataFrame(rows, schema)).collect()} == want
    many = [(k, f"alpha of n{k // 2} " + ("is found" if k % 2 else "surely is found"), {}, "missing_answer") for k in range(2000)]
    many = spark.createDataFrame(many, schema)
    assert compose.filled_candidates(many).count() <= 4000 and compose.filled_copies(many).count() == 1000


def test_store_at_the_edges(spark):
    canonicals = spark.createDataFrame([(1, "a"), (2, "b")], "id int, stem string")
    instances = spark.createDataFrame([("x", 1, 1), ("y", 2, None)], "document_id string, sequence int, canonical_id int")
    tasks = spark.createDataFrame([(1, 1, "x"), (2, 2, "z")], "task_id int, canonical_id int, document_id string")
    left, freed, open_ = store.detach(canonicals, instances, tasks, spark.createDataFrame([("x",)], "document_id string"))
    assert [(r.id, r.touched) for r in left.collect()] == [(2, False)] and freed.where("canonical_id IS NOT NULL").count() == 0 and [r.task_id for r in open_.collect()] == [2]
    drawn = [views.sample(spark.range(100), 7, seed).select("id", "place").collect() for seed in (1, 1, 2)]
    assert sorted(drawn[0]) == sorted(drawn[1]) != sorted(drawn[2]) and len(drawn[0]) == 7
    parsed = spark.createDataFrame([(["A", "B"], "q")], "o array<string>, id string").select(views.shuffled(F.transform("o", lambda k: F.struct(k.alias("key"))), F.col("id"), 3).alias("s")).first()
    assert sorted(o.key for o in parsed.s) == ["A", "B"]


def test_pages_are_read_as_a_stream(spark):
    """Rows and attempts come from one pass over pages in order: no group is held, no page is folded by expressions, and a page in parts is one."""
    def page(n, k, *more):
        return ("d", n, [item("Вопрос", 20, 10), item(str(k), 60, 10), item("Баллов: 1,00 из 1,00", 20, 30), item("The", 20, 50), item("⟪heart⟫", 50, 50), item("beats", 120, 50), *more])

    late = ("d", 2, [item("slowly", 150, 50), item(" ", 5, 5), {"str": "lost", "x": None, "y": 400.0, "w": 1.0, "h": None}, item(None, 1, 1)])
    pages = spark.createDataFrame([page(3, 6), late, page(1, 4), page(2, 5), ("e", None, None), ("f", 1, [])], PAGES)
    rows = review.review_rows(pages, review.side_cuts(pages))
    read = review.attempts(pages.join(review.heads(pages), "document_id"))
    for plan in (rows, read):
        told = plan._jdf.queryExecution().toString()
        assert "MapInArrow" in told and "FlatMapGroupsInPandas" not in told and "aggregate(" not in told
    found = rows.orderBy("document_id", "page", "row").collect()
    assert [(r.page, r.row, r.y, r.bottom, r.x, r.text) for r in found if r.page == 2] == [
        (2, 1, 10.0, 20.0, 20.0, "Вопрос 5"), (2, 2, 30.0, 40.0, 20.0, "Баллов: 1,00 из 1,00"), (2, 3, 50.0, 60.0, 20.0, "The ⟪heart⟫ beats slowly"), (2, 4, 400.0, None, None, "lost"),
    ]
    assert [(r.id, r.number, r.page, r.body, r.response) for r in read.orderBy("id").collect()] == [(0, 4, 1, "The ___ beats", "heart"), (1, 5, 2, "The ___ beats slowly lost", "heart"), (2, 6, 3, "The ___ beats", "heart")]


def test_rows_of_a_page_equal_a_fold(spark):
    """Against the fold told as a plain loop: random heights, both columns, ties and kinds of blanks."""
    rnd = random.Random(3)
    for _ in range(200):
        items = [(k, rnd.choice(["a", "b\u00a0c", " ", "!", "\u0138 x", "  d"]), float(rnd.randint(0, 4) * 30), rnd.choice([1, 2.5, 3, 6, 12, 13.5]) * rnd.randint(1, 3), rnd.choice([4.0, 10.0])) for k in range(rnd.randint(0, 9))]
        cut, wanted = rnd.choice([None, 45.0]), []
        for side in (True, False):
            rows = []
            for c, x, k, s, y, h in sorted((y + h / 2, x, k, s, y, h) for k, s, x, y, h in items if s.strip(" ") and (cut is not None and x < cut) == side):
                if rows and abs(c - rows[-1][0]) <= max(2.6, 0.4 * min(h, rows[-1][1])):
                    rows[-1][2].append((x, c, s, y, h))
                else:
                    rows.append((c, h, [(x, c, s, y, h)]))
            for _, _, own in rows:
                own.sort()
                text = " ".join(" ".join(i[2] for i in own if i[2].strip(" ") != "!").replace("\u0138", "к").replace("\u00a0", " ").split())
                wanted.append((min(i[3] for i in own), not side, text, max(i[3] + i[4] for i in own), own[0][0], [(i[0], i[2]) for i in own]))
        found = [(r.y, not r.side, r.text, r.bottom, r.x, r.items) for r in review.page_rows(items, cut)]
        assert found == sorted(wanted, key=lambda w: w[:3])
