"""Feedback lines, rows with one way left and unlabelled items against plain versions."""

import itertools
import random

from pyspark.sql import functions as F

from quizlode.operators import feedback, layout, review
from quizlode.plans import queries


def test_feedback_lines(spark):
    rows = [
        (1, "Белки плазмы и белки", ["белки", "Белки плазмы", "жиры"], None),
        (2, "белки плазмы", ["белки", "белки плазмы"], None),
        (3, "третий, первый; второй", ["первый", "второй", "третий"], "ORDERING"),
        (4, "сердце → насос, лёгкое -> газообмен; нечто → другое", ["Лёгкое", "Сердце"], None),
        (5, "сердце → насос; сердце → мышца", ["сердце"], "MATCHING"),
        (6, "канюля Люэра", [], None),
        (7, "совсем другое", ["первый"], None),
        (8, "", ["первый"], None), (9, None, ["первый"], None), (10, "первый", None, None),
        (11, "а б а б", ["а б", "а", "б а"], None),
    ]
    frame = spark.createDataFrame(rows, "id int, value string, options array<string>, kind string")
    found = {r.id: r.f for r in frame.select("id", feedback.named(F.col("value"), F.col("options"), F.col("kind")).alias("f")).collect()}
    assert found[1].told == [0, 1] or found[1].told == [1, 0]
    assert found[2].told == [1] and found[2].text_answer is None and found[2].right_order is None
    assert found[3].told == found[3].right_order == [2, 0, 1]
    assert found[4].pairs == {1: "насос", 0: "газообмен"} and found[4].text_answer == rows[3][1] and found[4].told == []
    assert found[5].pairs == {0: "мышца"}
    assert (found[6].told, found[6].text_answer) == ([], "канюля Люэра") and found[7].text_answer == "совсем другое"
    assert found[8] is None and found[9] is None and found[10].text_answer == "первый"
    assert found[11].told == [0, 1] or set(found[11].told) == {0, 1}


def test_named_options_equal_a_plain_walk(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        options = [" ".join(rnd.choices("abc", k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 5))]
        rows.append((i, " ".join(rnd.choices("abcd", k=rnd.randint(1, 9))), options))
    frame = spark.createDataFrame(rows, "id int, value string, options array<string>")
    found = {r.id: r.t for r in frame.select("id", feedback.named(F.col("value"), F.col("options"))["told"].alias("t")).collect()}
    for i, value, options in rows:
        taken, told = set(), []
        whole = f" {value} "
        for k in sorted(range(len(options)), key=lambda k: (-len(options[k]), k)):
            places = [p for p in range(len(whole)) if whole.startswith(f" {options[k]} ", p)]
            free = [p for p in places if not taken & set(range(p, p + len(options[k])))]
            if free:
                taken |= set(range(free[0], free[0] + len(options[k])))
                told.append((places[0], k))
        assert found[i] == [k for _, k in sorted(told)], rows[i]


def test_rows_with_one_way_left_equal_all_permutations(spark):
    rnd = random.Random(7)
    rows = [
        (0, ["x", "y", "z"], [("x", False), ("y", True), ("z", False)], ["x", None, None]), (1, ["x", "y"], [("x", False), ("y", True)], ["x", "y"]),
        (2, [str(k) for k in range(8)], [("", False)] * 8, [None] * 8), (3, [], [], []), (4, ["x"] * 8, [("y", True)] * 8, [None] * 8),
    ]
    for i in range(5, 700):
        n = rnd.randint(1, 5)
        values = [rnd.choice("xyz"[: rnd.randint(1, 3)]) for _ in range(n)]
        known = [v if rnd.random() < 0.3 else None for v in rnd.sample(values, n)]
        rows.append((i, values + (["w"] if rnd.random() < 0.1 else []), [(rnd.choice(["x", "y", "z", None]), rnd.random() < 0.6) for _ in range(n)], known))
    frame = spark.createDataFrame(rows, "id int, values array<string>, entries array<struct<value:string,wrong:boolean>>, known array<string>")
    found = {r.id: r.known for r in review.solve_remaining(frame).collect()}
    for i, values, entries, known in rows:
        pool = list(values)
        for v in known:
            if v in pool:
                pool.remove(v)
        free = [k for k, v in enumerate(known) if v is None]
        ways = set()
        if len(pool) == len(free) <= 7:
            ways = {p for p in itertools.permutations(pool) if all(not (entries[k][1] and entries[k][0] == v) for k, v in zip(free, p))}
        expected = list(known)
        if len(ways) == 1:
            for k, v in zip(free, ways.pop()):
                expected[k] = v
        assert found[i] == expected, rows[i]


def test_unlabelled_items(spark):
    rnd = random.Random(3)
    rows, y = [], 0
    for b in range(60):
        page, y = 1, 50.0
        for pos in range(rnd.randint(1, 7)):
            h = rnd.choice([8.0, 10.0])
            rows.append((b, pos, page, y, h))
            if rnd.random() < 0.15:
                page, y = page + 1, 50.0
            else:
                y += h + rnd.choice([1.0, 2.0, 6.0, 9.0] if b % 2 else [3.0])
    found = {(r.block, r.pos): r.item for r in layout.rhythm_blocks(spark.createDataFrame(rows, "block int, pos int, page int, y double, h double")).collect()}
    for b, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        gaps = [z[3] - a[3] - a[4] if a[2] == z[2] else None for a, z in zip(own, own[1:])]
        inside = [g for g in gaps if g is not None]
        most = max([*inside, 0])
        varied = bool(inside) and most - min(inside) > max(own[0][4] * 0.35, 2)
        item = 0
        assert found[b, 0] == 0
        for r, g in zip(own[1:], gaps):
            item += not (varied and g is not None and g < 0.6 * most)
            assert found[b, r[1]] == item
    assert layout.rhythm_blocks(spark.createDataFrame([], "block int, pos int, page int, y double, h double")).count() == 0


def test_values_are_worked_out_once_and_on_all_cores(spark):
    """A text's key is bound before its places are sought, and a small file doesn't keep the work in one task."""
    value = F.col("value")
    plan = str(feedback.intervals(F.upper("value"), F.array(value, value)))
    assert plan.count("upper(") == 1
    assert queries.QUERIES["feedback_intervals"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
