"""Windows of units (words or bytes), their anchors, and passages dealt to shards.

A window is named by the phrase in it with the smallest hash, its anchor: equal windows have equal anchors, and most
neighbours share one. Passages are the runs of windows around the anchors that recur. Where one anchor stands in more
passages than a shard holds, they are dealt again by their surroundings (see ``parts``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, forget, mix, odd_constants, pieces

_BASE = int(odd_constants(1, 41)[0])
_LOW = np.uint64(0xFFFFFFFF)


class Powers:
    """Powers of the rolling hash's base and of its inverse, as many as the longest text needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 2 * n
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def rolling(units: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of every run of ``size`` units."""
    n = len(units)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers.upto(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up)])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


class Units(NamedTuple):
    """How a text divides into units, how some are put together again, and the hashes they are compared by at first."""

    split: Callable[[bytes], bytes | list[bytes]]
    join: Callable[[bytes | list[bytes]], bytes]
    hashes: Callable[[bytes | list[bytes]], np.ndarray]


def words() -> Units:
    known = WordHashes()
    return Units(bytes.split, b" ".join, lambda w: known.of(w, len(w)))


def single_bytes() -> Units:
    same = lambda t: t
    return Units(same, same, lambda t: np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1))


def anchors(hashes: np.ndarray, window: int, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (a phrase of ``size`` units) of every window, and where it stands, the first place in the window.

    Phrases are chosen by half of their hash, then by place, which is the same for equal windows wherever they are.
    """
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    named = rolling(hashes, size, powers)
    chosen = sliding_min((named & ~_LOW) | np.arange(len(named), dtype=np.uint64), window - size + 1) & _LOW
    return named[chosen].view(np.int64), chosen.astype(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.string()).cast(pa.binary()).to_pylist()]


PASSAGES = "sha binary, start long, anchor long, passage binary, text binary"


def passages(window: int, size: int, kind: Callable[[], Units]):
    """Texts (sha, text, anchors) to the passages around those of their anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, units = Powers(), kind()
        for batch in pieces(batches, 100):
            rows: list[list] = [[] for _ in range(5)]
            for sha, text, wanted in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = units.split(text)
                named, _ = anchors(units.hashes(own), window, size, powers)
                edges = runs(named)
                keep = np.isin(named[edges[:-1]], np.array(wanted, np.int64))
                for a, b in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), strict=True):
                    part = units.join(own[a : b - 1 + window])
                    for column, x in zip(rows, (sha, a, int(named[a]), xxhash.xxh3_128_digest(part), part), strict=True):
                        column.append(x)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], ["sha", "start", "anchor", "passage", "text"])

    return scan


def _dealt_again(window: int, size: int, kind: Callable[[], Units]):
    """Parts to smaller ones, by what stands around their phrase; least and most bound how far a window reaches to the
    right of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, units = Powers(), kind()
        for batch in pieces(batches, 100):
            rows = []
            for p in batch.to_pylist():
                own, middle = units.split(p["text"]), (p["least"] + p["most"] + 1) // 2
                _, at = anchors(units.hashes(own), window, size, powers)
                reach = np.arange(len(at)) + window - size - at
                right = reach >= middle
                fits = (reach >= p["least"]) & (reach <= p["most"])
                edges = runs(at, right, fits)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if not fits[a]:
                        continue
                    x = int(at[a])
                    around = own[x + size : x + size + middle] if right[a] else own[x - (window - size - middle + 1) : x]
                    key = xxhash.xxh3_64_intdigest(units.join(around), p["key"] % (1 << 64) ^ int(right[a])) - (1 << 63)
                    least, most = (middle, p["most"]) if right[a] else (p["least"], middle - 1)
                    rows.append({**p, "offset": p["offset"] + a, "key": key, "least": least, "most": most, "text": units.join(own[a : b - 1 + window])})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return scan


def parts(found: DataFrame, window: int, size: int, kind: Callable[[], Units], shard_bytes: int, carried: list[str], several: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Passages (anchor, passage, text, and longs ``carried``) as parts (anchor, passage, offset, key, text, carried) whose
    keys hold ``shard_bytes`` at most, and the tables that they lie in.

    A phrase may stand in a third of all texts, each time in other surroundings. The passages of such an anchor are dealt
    again: windows that reach far to the right of the phrase by what stands there, the others, which reach far to the
    left, by what stands there; what is alone under its new key (not ``several``, an aggregate) is done with. Equal
    windows stay together. That goes on by halves of the reach, down to keys of whole windows, so it can always be done.
    """
    columns = ["anchor", "passage", "offset", "key", "least", "most", "text", *carried]
    schema = ", ".join(f"{c} {'binary' if c in ('passage', 'text') else 'int' if c in ('least', 'most') else 'long'}" for c in columns)
    open_ = found.withColumns({"offset": F.lit(0).cast("long"), "key": F.col("anchor"), "least": F.lit(0), "most": F.lit(window - size)}).select(*columns)
    settled, written = None, []
    while True:
        # equal texts of a key count once
        texts = open_.groupBy("key", F.xxhash64("text").alias("h")).agg(F.first(F.length("text")).alias("size"), F.max("most").alias("most"), F.max("least").alias("least"))
        keys = texts.groupBy("key").agg(F.sum("size").alias("bytes"), F.max("most").alias("most"), F.max("least").alias("least"))
        hot = cut(keys.where((F.col("bytes") > shard_bytes) & (F.col("most") > F.col("least"))).select("key"), "hot-keys")
        written.append(hot)
        if hot.isEmpty():
            return open_ if settled is None else settled.unionByName(open_), written
        calm = open_.join(hot, "key", "left_anti").select(*columns)
        settled = calm if settled is None else settled.unionByName(calm)
        again = open_.join(hot, "key", "left_semi").select(*columns).mapInArrow(_dealt_again(window, size, kind), schema)
        again = cut(again, "dealt-again")
        left = again.groupBy("key").agg(several.alias("_several")).where("_several").select("key")
        open_ = cut(again.join(left, "key", "left_semi").select(*columns), "dealt-parts")
        written.append(open_)
        forget(again)


def sharded(distinct: DataFrame, n_bytes: int, shard_bytes: int) -> DataFrame:
    """Rows (key, ...) with their shard; a shard holds ``shard_bytes`` on average."""
    return distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_bytes // shard_bytes)))))
