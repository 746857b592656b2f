"""Greedy grouping of questions against a plain replay over all rows, and over the engine's instances."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quizlode.functions import text
from quizlode.operators import engine, resolve
from tests.test_engine import exported, pages_of


def rows_of(spark, rows):
    frame = spark.createDataFrame(rows, "id long, document_id string, sequence int, stem string, options array<string>")
    return frame.withColumn("key", text.match_key(F.col("stem"))).withColumn("type", F.lit("SINGLE_CHOICE"))


def test_groups_equal_a_replay_over_everything(spark, tmp_path):
    rnd = random.Random(2)
    stems = [" ".join(rnd.choice(["vessel", "carries", "heart", "muscle", "tissue", "nerve", "blood"]) for _ in range(8)) for _ in range(12)]
    rows = []
    for i in range(80):
        words = rnd.choice(stems).split()
        if rnd.random() < 0.5:
            words[rnd.randrange(8)] = rnd.choice(["artery", "vein"])
        rows.append((i, f"d{i // 10}", i % 10, " ".join(words), rnd.sample(["a1", "b2", "c3", "d4"], 3)))
    frame = rows_of(spark, rows)
    found = {(r.id, r.canonical_id) for r in resolve.cluster(frame, str(tmp_path)).collect()}
    # exact repeats join their first copy; the rest is replayed in one go
    plain = frame.withColumn("generic", F.lit(False)).toPandas()
    plain["options"] = [sorted(o) for o in plain["options"]]
    plain["same"] = [(s, tuple(o)) for s, o in zip(plain["stem"], plain["options"])]
    first = plain.sort_values(["document_id", "sequence"]).drop_duplicates("same")
    placed = dict(resolve._replay(first)[["id", "canonical_id"]].itertuples(index=False))
    names = dict(zip(first["same"], first["id"]))
    assert found == {(r.id, placed[names[r.same]]) for r in plain.itertuples()}
    assert isinstance(first, pd.DataFrame) and len({c for _, c in found}) < len(rows)


def test_repeats_across_attempts_are_one_question(spark, tmp_path):
    found = engine.analyze(pages_of(spark, exported()))
    rows = found.select(F.xxhash64("instance_id").alias("id"), "document_id", "sequence", "stem", "key", "type", F.transform("options", lambda o: text.match_key(o["text"])).alias("options"))
    groups = resolve.cluster(rows, str(tmp_path)).collect()
    assert len(groups) == 7 and len({r.canonical_id for r in groups}) == 4


def test_no_questions(spark, tmp_path):
    assert resolve.cluster(rows_of(spark, []), str(tmp_path)).count() == 0


FOLDER = "/root/testdata/sf0.001"


def _grams(key):
    return {f" {key} "[i : i + 3] for i in range(len(key))}


def test_registered_groups_equal_plain_loops(spark):
    """The registered query on whole texts: every question in order against every group before it, by rules told here."""
    from quizlode.plans import queries
    from quizlode.sources import adapters

    rows = adapters.stems(spark, FOLDER).withColumn("generic", resolve.is_generic(F.col("stem"))).where("stem <> ''").orderBy("id").collect()
    of, groups, copies = {}, [], {}
    for r in rows:
        same = (r.stem, tuple(sorted(o or "" for o in r.options)))
        if same in copies:
            of[r.id] = copies[same]
            continue
        options, grams = {o for o in r.options if o}, _grams(r.key)
        long = sorted(dict.fromkeys(t for t in r.key.split(" ") if len(t) >= 4), key=lambda t: -len(t))
        keys, best = set(long[:4]) or {r.key[:12]}, None
        for g in groups:
            if not keys & g["keys"]:
                continue
            shared = len(options & g["options"]) / len(options | g["options"])
            generic = r.generic or g["generic"]
            if r.stem == g["stem"] or r.key == g["key"]:
                score, merge = 1.0 if r.stem == g["stem"] else 0.98, shared >= (0.99 if generic else 0.75)
            else:
                stem = len(grams & g["grams"]) / len(grams | g["grams"])
                score, merge = 0.65 * stem + 0.35 * shared, not generic and (stem >= 0.9 and shared >= 0.9 or stem >= 0.8 and shared >= 0.99)
                if stem < 0.6:
                    continue
            if best is None or score > best[0]:
                best = (score, merge, g)
        if best and best[1]:
            best[2]["options"] |= options
            of[r.id] = best[2]["id"]
        else:
            groups.append({"id": r.id, "stem": r.stem, "key": r.key, "grams": grams, "keys": keys, "generic": r.generic, "options": set(options)})
            of[r.id] = r.id
        copies[same] = of[r.id]
    found = {r.id: r.canonical_id for r in queries.QUERIES["greedy_clusters"](spark, FOLDER).collect()}
    assert found == of


def test_registered_cards_hold_their_questions(spark):
    """Every card is well-formed and shows number, question, options in order and answer."""
    from xml.etree import ElementTree

    from quizlode.plans import queries
    from quizlode.sources import adapters

    bank = {r.id: r for r in adapters.bank(spark, FOLDER).collect()}
    cards = queries.QUERIES["svg_cards"](spark, FOLDER).collect()
    assert {c.id for c in cards} == set(bank)
    for c in cards:
        b = bank[c.id]
        shown = [t.text for t in ElementTree.fromstring(c.svg).iter("{http://www.w3.org/2000/svg}text")]
        assert shown == [f"{c.number}. {b.question}", f"A) {b.category}", f"B) {b.document}", f'C) say "{b.category}"', f"Answer: {b.answer or '-'}"]


def test_blocks_in_parts_give_the_pairs_of_plain_loops(spark, tmp_path):
    """A word in all texts, met in parts of five rows or of few trigrams: each alike pair once, with its exact counts."""
    rnd = random.Random(5)
    stems = [" ".join(["everywhere", *rnd.choices(["nerve", "vein", "heart", "bone"], k=rnd.randint(1, 6))]) for _ in range(40)] + ["", "a", "ab"]
    frame = resolve.with_grams(rows_of(spark, [(i, "d", i, s, ["x", "y"][: i % 3]) for i, s in enumerate(stems)])).cache()
    grams = {r.id: set(r.grams) for r in frame.select("id", "grams").collect()}
    words = [{w for w in s.split() if len(w) >= 4} or {s} for s in stems]
    keys = [set(sorted(dict.fromkeys(w for w in s.split() if len(w) >= 4), key=lambda w: -len(w))[:4]) or {s} for s in stems]
    assert all(k <= w for k, w in zip(keys, words))
    wanted = {
        (i, j): (stems[i] == stems[j] != "", len(grams[i] & grams[j]), len(grams[i]), len(grams[j]), len({"x", "y"}) if i % 3 == j % 3 == 2 else min(i % 3, j % 3))
        for i in range(len(stems)) for j in range(i + 1, len(stems)) if keys[i] & keys[j] and len(grams[i] & grams[j]) >= 0.55 * len(grams[i] | grams[j])
    }
    for k, limits in enumerate(({"part_rows": 5}, {"part_grams": 200}, {})):
        rows = resolve.met(frame, frame, f"{tmp_path}/{k}", **limits).collect()
        assert len(rows) == len(wanted) and {(r.a_id, r.b_id): (r.same, r.shared, r.x, r.y, r.common) for r in rows} == wanted
    one, other = frame.where("id % 2 = 0"), frame.where("id % 2 = 1")
    across = resolve.met(one, other, f"{tmp_path}/across", part_rows=4).collect()
    assert sorted((min(r.a_id, r.b_id), max(r.a_id, r.b_id)) for r in across) == sorted(p for p in wanted if (p[0] + p[1]) % 2)
    assert all(r.a_id % 2 == 0 for r in across)


def test_a_component_is_replayed_without_its_texts():
    """Each row meets the rows that it is alike with, and the order decides; texts aren't there to be compared again."""
    near = lambda *ids: [{"id": i, "score": None, "stem": 0.95} for i in ids]
    rows = [(3, "d", 3, near(1, 2)), (1, "d", 1, near(3)), (2, "d", 2, near(3)), (9, "e", 1, near())]
    frame = pd.DataFrame([(i, False, d, n, ["yes"], False, e) for i, d, n, e in rows], columns=["id", "seed", "document_id", "sequence", "options", "generic", "near"])
    found = {r.id: (r.canonical_id, list(r.options or [])) for r in resolve._replay_pairs(frame).itertuples()}
    assert found == {1: (1, ["yes"]), 2: (2, ["yes"]), 3: (1, []), 9: (9, ["yes"])}


def test_rows_to_compare_hold_no_text(spark, tmp_path):
    """What is compared moves trigrams packed and texts by hash; equal rows are one, and short words block by the text's beginning."""
    from quizlode.functions import similarity

    stems = ["a long sentence on vessels " * 40, "a long sentence on vessels " * 40, "ab cd ef gh ij kl", "ab cd ef gh ij kl m", "ab cd", "which figure is it", ""]
    rows = rows_of(spark, [(i, "d", i, s, ["y", "x"] if i else ["x", "y"]) for i, s in enumerate(stems)])
    once, names = resolve.distinct(rows, str(tmp_path))
    assert sorted((r.id, r.first_id) for r in names.collect()) == [(0, 0), (1, 0), *((i, i) for i in range(2, 7))]
    found, plain = {r.id: r for r in once.collect()}, {r.id: r for r in resolve.with_grams(rows).collect()}
    assert sorted(found) == [0, 2, 3, 4, 5, 6]
    for i, r in found.items():
        assert similarity.unpacked(r.grams).tolist() == list(plain[i].grams) and r.n == plain[i].n_grams
        assert list(r.blocks) == list(plain[i].blocks) and r.generic == plain[i].generic == (i == 5)
    assert found[2].blocks == found[3].blocks == ["ab cd ef gh "]
    assert max(len(r.grams) + len(r.stem or b"") + len(r.key) for r in found.values()) < len(stems[0]) / 4
    assert {(r.a_id, r.b_id) for r in resolve.met(once, once, str(tmp_path / "met")).collect()} == {(2, 3)}


def test_a_text_with_many_letters_is_never_generic(spark):
    """The long key of a long text isn't made to learn that it is long; what it would be is the same."""
    stems = ["figure " * 7, "figure " * 6, "figure" + " ." * 400, "!" * 300 + "figure", "İ" * 44 + " figure", "рисунок" * 3, "figure " * 900, "", None]
    frame = spark.createDataFrame([(s,) for s in stems], "stem string")
    key = text.match_key(F.col("stem"))
    told = frame.select(resolve.is_generic(F.col("stem")).alias("a"), ((F.length(key) < 45) & key.rlike("(?iu)figure|рисун")).alias("b")).collect()
    assert [r.a or False for r in told] == [r.b or False for r in told] and any(r.a for r in told)
