"""Substring dedup by repeated-phrase automata.

A passage repeats if a window of ``window`` words occurs in several documents. Every window is named by an anchor: the
smallest hash among the phrases of a quarter of its length inside it, so equal windows have equal anchors, and only
about one phrase in twenty is an anchor. Anchors that occur in one document only are done with. Around the others the
passages are cut out, repeated copies of one passage are folded, and they are dealt to shards by anchor; the passages of
a phrase that stands everywhere are dealt again by their surroundings, so that bytes bound a shard. Each shard

- confirms its phrases: one counts if some window around it recurs, word by word, in passages of different documents;
- compiles an Aho-Corasick automaton of the confirmed phrases, which is all that it keeps of this step;
- streams all its passages through that automaton. The windows around the places that it locates, and no others, are
  compared word by word, phrase after phrase, and each gets the first document that has it.

Documents meet only the automata whose phrases they hold, so the work grows with the repeated text and not with shards
times texts. The locations go back to the documents, which drop the words of windows that start in an earlier one.

Whole copies (equal sequences of words) are folded first: all but the first lose everything.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, pieces, table
from .passages import PASSAGES, Powers, anchors, as_bytes, parts, passages, sharded, words

#: Bytes of passages that a shard holds.
SHARD_BYTES = 2 << 20

_NEVER = np.iinfo(np.int64).max


def phrase_length(window: int) -> int:
    return max(1, window // 4)


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, units = Powers(), words()
        for batch in pieces(batches):
            n, shas, found = [], [], []
            for text in as_bytes(batch.column(2)):
                own = text.split()
                n.append(len(own))
                shas.append(hashlib.sha256(b" ".join(own)).digest())
                named = anchors(units.hashes(own), window, phrase_length(window), powers)[0] if len(own) >= window else np.empty(0, np.int64)
                found.append(np.unique(named))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "version", "n_words", "sha", "anchors"],
            )

    return scan


def _edges(text: bytes) -> np.ndarray:
    """Where the words of a text with single blanks begin, and where one after the last would."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]])


class Shard:
    """Passages (texts of words with single blanks) and the first and last document of each."""

    def __init__(self, texts: list[bytes], firsts: list[int], lasts: list[int], window: int) -> None:
        self.texts, self.firsts, self.lasts, self.window, self.size = texts, firsts, lasts, window, phrase_length(window)
        self.edges = [_edges(t) for t in texts]
        numbers: dict[bytes, int] = {}
        self.codes = [tuple(numbers.setdefault(w, len(numbers)) for w in t.split()) for t in texts]

    def windows(self, row: int, places: list[int]) -> Iterator[tuple[int, bytes]]:
        """The windows (start, words) of a passage that hold one of the phrases which begin at ``places``, each once."""
        e, text, done = self.edges[row], self.texts[row], 0
        for p in places:
            for i in range(max(done, p + self.size - self.window), done := max(done, min(len(e) - self.window, p + 1))):
                yield i, text[e[i] : e[i + self.window] - 1]

    def phrases(self) -> dict[tuple, dict[int, list[int]]]:
        """The anchors of the passages, each with the passages that are named by it and where it stands in them."""
        powers, units = Powers(), words()
        found: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for row, text in enumerate(self.texts):
            _, at = anchors(units.hashes(text.split()), self.window, self.size, powers)
            for p in np.unique(at).tolist():
                found[self.codes[row][p : p + self.size]][row].append(p)
        return found

    def first_documents(self, places: dict[int, list[int]]) -> dict[bytes, int]:
        """The windows around ``places`` that are in passages of different documents, and the first document of each."""
        first: dict[bytes, int] = {}
        last: dict[bytes, int] = {}
        for row, at in places.items():
            for _, w in self.windows(row, at):
                first[w] = min(self.firsts[row], first.get(w, _NEVER))
                last[w] = max(self.lasts[row], last.get(w, -_NEVER))
        return {w: d for w, d in first.items() if d < last[w]}

    def automaton(self) -> ahocorasick.Automaton:
        """An automaton of the phrases around which some window recurs."""
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in self.phrases().items():
            if self.first_documents(places):
                found.add_word(phrase, phrase)
        found.make_automaton()
        return found

    def located(self, automaton: ahocorasick.Automaton) -> list[np.ndarray]:
        """For each passage the first document of each of its windows, a huge number where the automaton shows nothing."""
        hits: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for row, code in enumerate(self.codes):
            for end, phrase in automaton.iter(code) if len(automaton) else ():
                hits[phrase][row].append(end - self.size + 1)
        out = [np.full(max(0, len(c) - self.window + 1), _NEVER) for c in self.codes]
        while hits:
            _, places = hits.popitem()
            known = self.first_documents(places)
            for row, at in places.items() if known else ():
                for i, w in self.windows(row, at):
                    out[row][i] = min(out[row][i], known.get(w, _NEVER))
        return out


_FOUND = "key long, passage_of_key binary, firsts array<long>"


def _located(window: int):
    """A shard (key, text, first, last): the first document of each window of each text."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(frame["text"].tolist(), frame["first"].tolist(), frame["last"].tolist(), window)
        found = shard.located(shard.automaton())
        rows = [(k, hashlib.sha256(t).digest(), f) for k, t, f in zip(frame["key"].tolist(), shard.texts, found, strict=True) if (f < _NEVER).any()]
        return pd.DataFrame(rows, columns=["key", "passage_of_key", "firsts"])

    return run


def _remove(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, kept, shas = [], [], []
            for text, starts in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                own = text.split()
                open_ = np.zeros(len(own) + 1, np.int64)
                at = np.array(starts, np.int64)
                np.add.at(open_, at, 1)
                np.add.at(open_, at + window, -1)
                gone = np.cumsum(open_)[:-1] > 0
                left = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
                removed.append(int(gone.sum())), kept.append(left.decode()), shas.append(hashlib.sha256(left).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.binary())],
                ["doc_id", "version", "removed", "left", "left_sha"],
            )

    return scan


def repeated_phrases(docs: DataFrame, window: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id long, text): doc_id, n_words, n_removed, kept_text and kept_sha256.

    Words are runs without ASCII white space. A word is removed if a run of ``window`` words around it also starts in a
    document with a smaller doc_id. kept_text is null where nothing is removed (the text stays as it is), else the words
    left, joined by blanks; kept_sha256 is the hash of the words left, joined by blanks, in either case. A null text has
    no words. Rows without a doc_id lose nothing and take nothing from others; rows that repeat a doc_id take nothing
    from each other, and those of them with the same words lose the same. An empty table gives no rows; other columns
    are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))
    rows = cut(plain.mapInArrow(_scan(window), "doc_id long, version long, n_words long, sha binary, anchors array<long>"), "phrases")
    usable = rows.where("doc_id IS NOT NULL").where(F.col("n_words") >= window)
    classes = usable.groupBy("sha").agg(F.min(F.struct("doc_id", "version", "anchors")).alias("r"))
    classes = cut(classes.select("sha", "r.*"), "phrase-classes")

    spread = classes.select("doc_id", "version", F.explode("anchors").alias("anchor"))
    ends = spread.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    lists = spread.join(ends.select("anchor"), "anchor").groupBy("doc_id", "version").agg(F.collect_list("anchor").alias("anchors"))
    texts = plain.where("doc_id IS NOT NULL AND text IS NOT NULL")
    holders = texts.join(lists.hint("merge"), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])
    holders = cut(holders.select("doc_id", "version", "text", "anchors"), "phrase-holders")
    size = phrase_length(window)
    # passages know their text by its id and version
    named = holders.select(F.to_binary(F.concat_ws(" ", "doc_id", "version"), F.lit("utf-8")).alias("sha"), "text", "anchors")
    places = named.mapInArrow(passages(window, size, words), PASSAGES)
    own = F.split(F.decode("sha", "utf-8"), " ")
    places = places.select(own[0].cast("long").alias("doc_id"), own[1].cast("long").alias("version"), "start", "anchor", "passage", "text")
    places = cut(places, "passages")

    whole = places.groupBy("anchor", "passage", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    whole = cut(whole, "distinct-passages")
    dealt, written = parts(whole, window, size, words, shard_bytes, ["first", "last"], F.min("first") < F.max("last"))
    distinct = dealt.groupBy("key", "text").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    n_bytes = whole.agg(F.sum(F.length("text"))).first()[0] or 0
    firsts = cut(sharded(distinct, n_bytes, shard_bytes).groupBy("shard").applyInPandas(_located(window), _FOUND), "located")
    told = dealt.select("anchor", "passage", "offset", "key", F.unhex(F.sha2("text", 256)).alias("passage_of_key")).join(firsts, ["key", "passage_of_key"])
    told = cut(told.select("anchor", "passage", "offset", "firsts"), "told-passages")
    found = places.drop("text").join(told, ["anchor", "passage"])
    earlier = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + F.col("offset") + i)), lambda x: x.isNotNull())
    found = found.select("doc_id", "version", earlier.alias("starts")).where(F.size("starts") > 0)
    found = cut(found.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts")), "phrase-starts")
    forget(whole, places, firsts, told, *written)
    rests = holders.select("doc_id", "version", "text").join(found.hint("merge"), ["doc_id", "version"])
    rests = rests.mapInArrow(_remove(window), "doc_id long, version long, removed long, left string, left_sha binary")

    # every row gets what the first row with its words loses, or all if that is of an earlier document
    judged = classes.drop("anchors").join(rests, ["doc_id", "version"], "left")
    judged = cut(judged.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_first"), "removed", "left", "left_sha"), "phrase-parts")
    forget(holders, found, classes)
    out = rows.drop("anchors").join(judged, F.col("sha") == F.col("_sha"), "left")
    own = F.col("doc_id").isNotNull() & F.col("_first").isNotNull()
    copy = own & (F.col("_first") < F.col("doc_id"))
    kept = F.when(copy, F.lit("")).when(own, F.col("left"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        kept.alias("kept_text"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.when(own, F.coalesce("left_sha", "sha")).otherwise(F.col("sha"))))).alias("kept_sha256"),
    )


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    return repeated_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"), 50).drop("kept_text")
