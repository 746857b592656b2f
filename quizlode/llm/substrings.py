"""Substring dedup by suffix arrays of shards, sorted by inducing.

A string of ``window`` bytes is repeated if it starts at two places of all texts. Every window is named by an anchor,
the smallest hash among the phrases of a fifth of its length inside it, so equal windows have equal anchors, and
consecutive windows mostly share one. Anchors that occur at one place only are done with. Around the others the passages
are cut out, equal passages are folded (with their number, up to two), and they are dealt to shards by anchor. Each
shard builds the suffix array of its passages by induced sorting and the permuted common prefixes, and a window is
repeated where its suffix shares ``window`` bytes with a neighbour. What shards find goes back to the texts.

The passages of a phrase that stands everywhere are dealt again by their surroundings until no key holds more bytes than
a shard. No windows are compared by hashes: those only choose the shard.

Equal texts are folded first: one of them stands for all, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, pieces, table
from .passages import PASSAGES, Powers, anchors, as_bytes, parts, passages, runs, sharded, single_bytes
from .suffixes import repeated_starts

#: Bytes of passages that a shard holds.
SHARD_BYTES = 1 << 20


def phrase_bytes(window: int) -> int:
    return max(1, window // 5)


def _scan(window: int):
    """Texts to their anchors; ``twice`` are those that the text has at several places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, units = Powers(), single_bytes()
        for batch in pieces(batches):
            n, once, twice = [], [], []
            for text in as_bytes(batch.column(2)):
                n.append(len(text))
                named, at = anchors(units.hashes(text), window, phrase_bytes(window), powers)
                edges = runs(named)
                first = edges[:-1]
                values, counts = np.unique(np.concatenate([named[first], named[first[at[first] != at[edges[1:] - 1]]]]), return_counts=True)
                once.append(values[counts == 1]), twice.append(values[counts > 1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(once, longs), pa.array(twice, longs)],
                ["doc_id", "sha", "n_bytes", "once", "twice"],
            )

    return scan


_FOUND = "key long, passage_of_key binary, starts array<long>, ends array<long>"


def _located(window: int):
    """A shard (key, text, copies): the runs of windows of each text that start anywhere else."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame["text"].tolist()
        out = []
        for key, text, found in zip(frame["key"].tolist(), texts, repeated_starts(texts, frame["n"].tolist(), window), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
            if len(edges):
                out.append((key, hashlib.sha256(text).digest(), edges[::2], edges[1::2]))
        return pd.DataFrame(out, columns=["key", "passage_of_key", "starts", "ends"])

    return run


def _remove(window: int):
    """Texts with the runs (s, e) of their repeated windows to what is left of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 100):
            removed, spans, kept, shas = [], [], [], []
            for text, gone in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                left, at, n = [], 0, 0
                end = -1
                for r in sorted(gone, key=lambda r: r["s"]):
                    if r["s"] > end:  # else the runs overlap or touch
                        n += 1
                        left.append(text[at : r["s"]])
                    at = end = max(end, r["e"] - 1 + window)
                left.append(text[at:])
                rest = b"".join(left)
                removed.append(len(text) - len(rest)), spans.append(n), kept.append(rest), shas.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(shas, pa.string())],
                ["sha", "removed", "spans", "left", "left_sha"],
            )

    return scan


def repeated_substrings(docs: DataFrame, window: int = 400, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_bytes, kept_sha256.

    Texts are UTF-8 bytes. A byte is removed if it is covered by a string of ``window`` bytes that starts at any other
    place too, in the same row or another one; no copy stays. n_spans counts the maximal runs removed. kept_bytes is null
    where nothing is removed, else the bytes left (characters may be cut); kept_sha256 is the hash of the bytes left. A
    null text has none; every row is a document of its own, with a doc_id or without, also where rows repeat. An empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = cut(plain.mapInArrow(_scan(window), f"doc_id {kind}, sha binary, n_bytes long, once array<long>, twice array<long>"), "substrings")
    classes = rows.where(F.col("n_bytes") >= window).groupBy("sha").agg(
        F.count("*").alias("n"), F.min_by(F.struct("once", "twice"), "doc_id").alias("a"), F.first(F.struct("once", "twice")).alias("b"), F.min("doc_id").alias("first")
    )
    classes = cut(classes.select("sha", "n", "first", F.coalesce("a", "b").alias("a")).select("sha", "n", "first", "a.*"), "substring-classes")

    several = F.least("n", F.lit(2).cast("long"))
    each = lambda c, times: classes.select("sha", "first", F.explode(c).alias("anchor"), (several * times).alias("n"))
    spread = each("once", 1).unionByName(each("twice", 2))
    recurring = spread.groupBy("anchor").agg(F.sum("n").alias("places")).where("places > 1").select("anchor")
    lists = spread.join(recurring, "anchor").groupBy("sha", "first").agg(F.collect_list("anchor").alias("anchors"))
    # the row that stands for its class; ids spread what copies of one text would gather
    lists = lists.select(F.col("sha").alias("_sha"), F.col("first").alias("_first"), "anchors").hint("merge")
    holders = plain.join(lists, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["sha"])
    holders = cut(holders.select("sha", "text", "anchors"), "substring-holders")
    size = phrase_bytes(window)
    places = cut(holders.mapInArrow(passages(window, size, single_bytes), PASSAGES), "substring-passages")

    counted = places.join(classes.select("sha", several.alias("n")), "sha")
    whole = cut(counted.groupBy("anchor", "passage", "text").agg(F.sum("n").alias("n")), "distinct-substrings")
    dealt, written = parts(whole, window, size, single_bytes, shard_bytes, ["n"], F.sum("n") > 1)
    distinct = dealt.groupBy("key", "text").agg(F.sum("n").alias("n"))
    n_bytes = whole.agg(F.sum(F.length("text"))).first()[0] or 0
    found = cut(sharded(distinct, n_bytes, shard_bytes).groupBy("shard").applyInPandas(_located(window), _FOUND), "repeated-substrings")

    told = dealt.select("anchor", "passage", "offset", "key", F.unhex(F.sha2("text", 256)).alias("passage_of_key")).join(found, ["key", "passage_of_key"])
    at = F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct((r["starts"] + F.col("offset")).alias("s"), (r["ends"] + F.col("offset")).alias("e")))
    told = cut(told.select("anchor", "passage", at.alias("runs")), "told-substrings")
    at = F.transform("runs", lambda r: F.struct((r["s"] + F.col("start")).alias("s"), (r["e"] + F.col("start")).alias("e")))
    own = places.drop("text").join(told, ["anchor", "passage"]).groupBy("sha").agg(F.flatten(F.collect_list(at)).alias("runs"))
    own = cut(own.withColumnRenamed("sha", "_sha"), "substring-runs")
    forget(places, whole, found, told, *written)
    cleaned = holders.join(own.hint("merge"), F.col("sha") == F.col("_sha")).select("sha", "text", "runs")
    cleaned = cut(cleaned.mapInArrow(_remove(window), "_sha binary, removed long, spans long, left binary, left_sha string"), "substring-rests")
    forget(holders, own, classes)

    out = rows.drop("once", "twice").join(cleaned, F.col("sha") == F.col("_sha"), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.col("left").alias("kept_bytes"),
        F.coalesce("left_sha", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def op11_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    return repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_bytes")
