"""Imports one after another against one import of all, the store of pictures, and steps that are published at once."""

import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizlode.functions import similarity
from quizlode.operators import grouping, pictures, resolve
from quizlode.plans import imports
from quizlode.sources import versions, work_folder
from tests.test_cluster import rows_of


def some_rows(seed, n):
    rnd = random.Random(seed)
    stems = [" ".join(rnd.choice(["vessel", "carries", "heart", "muscle", "tissue", "nerve", "blood"]) for _ in range(8)) for _ in range(10)]
    rows = []
    for i in range(n):
        words = rnd.choice(stems).split()
        if rnd.random() < 0.5:
            words[rnd.randrange(8)] = rnd.choice(["artery", "vein"])
        rows.append((i, f"d{i // 10:02d}", i % 10, " ".join(words) if i % 17 else "", rnd.sample(["a1", "b2", "c3", "d4"], 3)))
    return rows


def test_imports_one_after_another_equal_one_import(spark, tmp_path):
    rows = some_rows(2, 90)
    frame = rows_of(spark, rows)
    whole = {(r.id, r.canonical_id) for r in resolve.cluster(frame, str(tmp_path / "whole")).collect()}
    once = grouping.import_questions(frame, str(tmp_path / "once")).collect()
    assert {(r.id, r.canonical_id) for r in once} == whole and len(once) == len(whole)
    found, reviews = set(), set()
    for k, (a, b) in enumerate(((0, 30), (30, 30), (30, 60), (60, 90))):
        part = grouping.import_questions(frame.where(f"id >= {a} AND id < {b}"), str(tmp_path / "parts")).collect()
        found |= {(r.id, r.canonical_id) for r in part}
        reviews |= {(r.id, r.review_of) for r in part}
    assert found == whole and reviews == {(r.id, r.review_of) for r in once}
    state = lambda name: {(r.id, r.stem, tuple(r.options)) for r in grouping.groups(spark, str(tmp_path / name)).collect()}
    assert state("parts") == state("once") and {c for _, c in whole} == {i for i, *_ in state("once")}


def test_an_import_reads_only_the_groups_it_can_touch(spark, tmp_path):
    store = str(tmp_path / "store")
    far = rows_of(spark, [(i, "a", i, f"completely{'xyz'[i % 3] * (i + 1)} other", ["a1"]) for i in range(8)])
    grouping.import_questions(far, store)
    before = versions.manifest(spark, store)
    out = grouping.import_questions(rows_of(spark, [(100, "b", 0, "heart pumps blood through vessels", ["a1", "b2"]), (101, "b", 1, "Heart pumps blood through vessels!", ["a1", "b2"])]), store)
    assert {(r.id, r.canonical_id) for r in out.collect()} == {(100, 100), (101, 100)}
    after = versions.manifest(spark, store)
    assert all(after[t][:-1] == before[t] for t in after)  # what was there is not written again
    assert versions.published(spark, store, "groups", grouping._GROUPS).where("delta = 1").count() == 1


def test_pictures(spark, tmp_path):
    store = str(tmp_path / "pictures")
    rows = lambda *p: spark.createDataFrame([(n, c and bytearray(c)) for n, c in p], "name string, content binary")
    first = {r.name: r.id for r in pictures.put(spark, store, rows(("a", b"one"), ("b", b"two"), ("c", b"one"), ("d", None), ("e", b""))).collect()}
    assert first["a"] == first["c"] != first["b"] and first["d"] is None and pictures.stored(spark, store).count() == 2 + 1
    again = {r.name: r.id for r in pictures.put(spark, store, rows(("x", b"two"), ("y", b"three"))).collect()}
    assert again["x"] == first["b"] and pictures.stored(spark, store).count() == 4
    ids = spark.createDataFrame([(first["a"],), (again["y"],), ("unknown",)], "id string")
    assert {r.id: r.content and bytes(r.content) for r in pictures.get(spark, store, ids).collect()} == {first["a"]: b"one", again["y"]: b"three", "unknown": None}
    pictures.delete(spark, store, ids)
    assert {bytes(r.content) for r in pictures.stored(spark, store).collect()} == {b"two", b""}
    pictures.clear(spark, store)
    assert pictures.stored(spark, store).count() == 0 and len(versions.manifest(spark, store)["pictures"]) == 1


def test_a_lost_step_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    versions.publish(spark, store, {"t": spark.range(3)})
    fails = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, store, {"t": spark.range(3, 6), "u": fails})
    assert versions.published(spark, store, "t", "id long").count() == 3 and "u" not in versions.manifest(spark, store)


def test_no_local_work_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="checkpoint"):
        work_folder(Session, "x")


def test_components_are_dealt_to_tasks_by_many(spark):
    """Components are replayed by buckets of them: one call for each would cost more than its rows."""
    nodes = spark.range(400).selectExpr("id", "false AS seed", "'d' AS document_id", "id AS sequence", "array('yes') AS options", "false AS generic")
    pairs = spark.range(0, 400, 2).selectExpr("id AS u", "id + 1 AS v", "1.0D AS score", "1.0D AS stem")
    found = spark.range(400).selectExpr("id AS node", "id - id % 2 AS component")
    out = resolve.replayed(nodes, pairs, found)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [deal" in plan
    assert {(r.id, r.canonical_id) for r in out.collect()} == {(i, i - i % 2) for i in range(400)}


def test_the_median_is_found_without_all_values_in_one_task(spark):
    rnd = random.Random(4)
    for n in (0, 1, 2, 5, 1000, 20_001):
        values = [rnd.randrange(n // 3 + 1) if n % 2 else rnd.randrange(10**9) for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
        assert imports._median(rows, "v") == (statistics.median(values) if values else None)


def test_small_blocks_are_met_together(spark, tmp_path):
    """As many pairs as one block after another gives, and stems' keys are folded once for all steps."""
    rows = rows_of(spark, some_rows(5, 300))
    counted = resolve.with_grams(rows.where("stem <> ''"))
    assert "regexp" not in resolve._sides(counted.localCheckpoint())._jdf.queryExecution().optimizedPlan().toString().lower()
    found = []
    for few in (16, 0):
        resolve.FEW_ROWS = few
        frame = resolve._sides(counted).drop("blocks").join(counted.select("id", "blocks"), "id").selectExpr("*", "2 AS side", "true AS own").toPandas()
        made = [resolve._meet(part) for _, part in frame.groupby(frame["block"].map(len))]
        found.append(sorted(tuple(map(str, r)) for part in made for r in part.itertuples(index=False)))
    resolve.FEW_ROWS = 16
    assert found[0] and found[0] == found[1]


def test_trigrams_of_many_texts_at_once():
    texts = ["", None, "a", "ab ab ab", "né 😀 x", " ", "aaaaaa"]
    pairs = [f" {t or ''} " for t in texts]
    wanted = [sorted({(ord(p[i]) << 42) | (ord(p[i + 1]) << 21) | ord(p[i + 2]) for i in range(len(p) - 2)}) for p in pairs]
    assert [list(x) for x in similarity.trigram_codes.func(pd.Series(texts))] == wanted
