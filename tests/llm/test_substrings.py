"""Suffix arrays and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quizlode.llm import registry, substrings, suffixes
from quizlode.llm.common import table

from .test_corpus_operators import AWKWARD, docs_of, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("long_buckets", [0, 64, 10**9])
def test_suffix_arrays_and_common_prefixes(monkeypatch, long_buckets):
    monkeypatch.setattr(suffixes, "LONG_BUCKETS", long_buckets)
    rnd = random.Random(1)
    for _ in range(150):
        k = rnd.choice([1, 2, 3, 10])
        text = np.array([rnd.randint(1, k) for _ in range(rnd.randint(0, 120))] + [0], np.uint16)
        plain = text.tolist()
        sa = suffixes.suffix_array(text, k + 1).tolist()
        assert sa == sorted(range(len(plain)), key=lambda i: plain[i:])
        shared = suffixes.common_prefixes(text, np.array(sa)).tolist()
        for a, b in zip(sa, sa[1:]):
            assert shared[b] == next(n for n in range(len(plain)) if plain[a + n] != plain[b + n])


def test_names_are_sorted_together(monkeypatch):
    """The names of a long text are not induced one by one, which took most of the time of a shard."""
    monkeypatch.setattr(suffixes, "_induced_one_by_one", None)
    rnd = random.Random(3)
    part = bytes(rnd.choice(b"abcd ") for _ in range(9_000))
    texts = [part, part[1_000:] + b"x", b"ab" * 5_000, bytes(rnd.randrange(256) for _ in range(3_000))]
    found = suffixes.repeated_starts(texts, [1, 1, 1, 1], 400)
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    assert [f.tolist() for f in found] == [[seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)] for t in texts]


@pytest.mark.parametrize("n", [1, 2, 300, (1 << 21) + 5])
def test_doubling_of_many_names(n):
    names = np.append(np.random.default_rng(n).integers(1, 3 if n < 1000 else n, n), 0)
    sa = suffixes._doubled(names)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.arange(n + 1)
    a, b = sa[:-1], sa[1:]
    assert len(np.unique(sa)) == n + 1 and ((names[a] < names[b]) | ((names[a] == names[b]) & (rank[np.minimum(a + 1, n)] < rank[np.minimum(b + 1, n)]))).all()


def brute_substrings(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def found_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_substrings_equal_brute_force(spark, shard_bytes):
    """Shared passages whole and in part, near copies, repeats inside a text, periodic texts; a common phrase in other
    surroundings each time, so that with small shards its passages are dealt again down to single windows."""
    rnd = random.Random(2)
    shared = [" ".join(words(rnd, 30)) for _ in range(4)]
    phrase = "é the phrase that stands everywhere "
    rows = []
    for d in range(60):
        parts = [" ".join(words(rnd, rnd.randint(1, 12)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            parts += [p[a : a + rnd.randint(20, 200)], phrase[rnd.randrange(12) :], " ".join(words(rnd, rnd.randint(1, 12)))]
        rows.append((d, rnd.choice(["", " ", "\n"]).join(parts)))
    near = list(rows[7][1])
    near[len(near) // 2] = "#"
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[5][1]), (101, "".join(near)), (102, "ab" * 60), (103, "x" * 51), (104, "x" * 50), (105, shared[0] + "-" + shared[0])]
    found = substrings.repeated_substrings(docs_of(spark, rows), 50, shard_bytes)
    assert found_of(found) == brute_substrings(rows, 50)


def test_substrings_of_awkward_rows(spark):
    rows = [*AWKWARD, (None, None), (30, "y" * 30_000), (31, "é" * 200 + "ü" * 200)]
    assert found_of(substrings.repeated_substrings(docs_of(spark, rows), 400)) == brute_substrings(rows, 400)
    assert substrings.repeated_substrings(docs_of(spark, [])).count() == 0


def test_suffix_arrays_decide(spark, monkeypatch):
    """Without them nothing is found, and what is left of a text is what its hash is of."""
    rnd = random.Random(9)
    rows = [(d, " ".join(words(rnd, 20)) + "the very same passage of more than fifty bytes, again and again") for d in range(5)]
    found = substrings.repeated_substrings(docs_of(spark, rows), 50).collect()
    assert all(r.n_removed >= 60 and hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in found)
    monkeypatch.setattr(substrings, "repeated_starts", lambda texts, copies, window: [np.zeros(max(0, len(t) - window + 1), bool) for t in texts])
    assert all(r.n_removed == 0 for r in substrings.repeated_substrings(docs_of(spark, rows), 50).collect())


def test_registered_substrings_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert found_of(registry.QUERIES["op11_repeated_substrings"](spark, FOLDER)) == brute_substrings(rows, 400)
