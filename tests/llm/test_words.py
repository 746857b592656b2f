"""Spelling variants and ranked search against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlode.llm import ranked, registry, spelling
from quizlode.llm.common import table

from .test_corpus_operators import AWKWARD, docs_of, words

FOLDER = "/root/testdata/sf0.001"


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(rows, least=7, count=2, times=10):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_equal_brute_force(spark):
    """Short words of few letters, so that most have several neighbours, with chains of forms and ties."""
    rnd = random.Random(3)
    rows = []
    stems = ["abcdefg", "aaaaaaa", "aabaabaa", "éàüabcdÿ", "Abcdefgh"]
    for d in range(60):
        text = []
        for _ in range(400):
            w = list(rnd.choices(stems, [400, 40, 4, 10, 1])[0])
            for _ in range(rnd.choices([0, 1, 2, 3], [60, 30, 8, 2])[0]):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é"])
            text.append("".join(w) + rnd.choice([" ", "-", "\n", "3"]))
        rows.append((d, "".join(text)))
    found = spelling.spelling_variants(docs_of(spark, rows)).collect()
    expected = brute_variants(rows)
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert any(f is not None and r != f for _, f, r, *_ in expected)


def test_variants_of_awkward_rows(spark):
    rows = [*AWKWARD, (None, "Wordless wordless"), (40, "l" * 100_000 + " " + "l" * 100_000), (41, "wordles wordles")]
    found = {tuple(r) for r in spelling.spelling_variants(docs_of(spark, rows)).collect()}
    assert found == brute_variants(rows)
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0


def test_registered_variants_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    found = {tuple(r) for r in registry.QUERIES["op13_spelling_variants"](spark, FOLDER).collect()}
    assert found == brute_variants(rows)


# --- ranked search ---------------------------------------------------------------------------------------------------


def brute_search(rows, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in docs:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            s = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s:
                scores.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda r: r[:2])


def asked(spark, items):
    return spark.createDataFrame(items, "item long, text string")


@pytest.mark.parametrize("block", [7, 10_000])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    rnd = random.Random(4)
    few = words(rnd, 60)
    rows = [(d, " ".join(rnd.choices(few, k=rnd.randint(0, 30)))) for d in range(120)]
    rows += [(200 + d, rows[d][1]) for d in range(30)] + [(5, rows[5][1]), (5, "of its own an an"), (None, rows[7][1]), (None, None), (300, "É é eé 12 a1b")]
    items = [(i, " ".join(rnd.choices(few + ["unknown"], k=rnd.randint(1, 12)))) for i in range(25)] + [(30, None), (31, ""), (32, "unknown"), (33, "É A1B 12 12")]
    found = ranked.lexical_search(docs_of(spark, rows), asked(spark, items)).orderBy("item", "rank").collect()
    assert [tuple(r) for r in found] == brute_search(rows, items)


def test_search_in_batches_over_the_whole_index(spark):
    rnd = random.Random(6)
    few = words(rnd, 40)
    rows = [(d, " ".join(rnd.choices(few, k=20))) for d in range(80)]
    items = [(i, " ".join(rnd.choices(few, k=8))) for i in range(20)]
    index = ranked.impact_index(docs_of(spark, rows))
    found = ranked.search(index, asked(spark, items), 5, batch_terms=20).orderBy("item", "rank").collect()
    assert [tuple(r) for r in found] == brute_search(rows, items, 5)
    # the slices decide: with the highest bits of a term gone, scores change
    assert index.where("term <> ''").agg(F.count("*")).first()[0] == len({t for _, x in rows for t in x.split()})


def test_search_of_awkward_rows(spark):
    rows = [*AWKWARD, (50, "one " * 100_000)]
    items = [(1, "one two"), (2, "same text"), (3, "x"), (4, "one " * 3000)]
    found = ranked.lexical_search(docs_of(spark, rows), asked(spark, items)).orderBy("item", "rank").collect()
    assert [tuple(r) for r in found] == brute_search(rows, items)
    assert ranked.lexical_search(docs_of(spark, []), asked(spark, items)).count() == 0
    assert ranked.lexical_search(docs_of(spark, rows), asked(spark, [])).count() == 0


def test_bit_sliced_sums_and_tops():
    rnd = np.random.default_rng(1)
    numbers = rnd.integers(0, 1 << 38, (9, 200)) >> rnd.integers(0, 38, (9, 200))
    sliced = [np.packbits(np.unpackbits(np.pad(ranked.slices_of(x), ((0, 0), (0, 7))), axis=1), axis=1).view(np.uint64) for x in numbers]
    total = ranked.add(sliced)
    sums = numbers.sum(axis=0)
    bits = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, :200].astype(np.int64)
    assert ((bits << np.arange(len(bits))[:, None]).sum(axis=0) == sums).all()
    for k in (1, 7, 50, 199, 300):
        sure, tied = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in ranked.top(total, k))
        least = np.sort(sums)[::-1][min(k, 200) - 1]
        assert set(np.flatnonzero(sums > max(least, 0))) <= set(sure) and len(sure) <= k and (sums[tied] == least).all()
