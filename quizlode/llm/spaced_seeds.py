"""Benchmark decontamination by spaced-seed hashing.

A seed mask looks at six of up to eleven neighbouring tokens and ignores the rest, so that a substituted token at an
ignored place does not hide a match. All masked positions of the benchmark are hashed into a lookup table; every
position of every training text is hashed with the same masks and joined with that table inside the scan, so no text
is shuffled. Each hit names a diagonal (text position minus item position), on which the item is laid beside the text
and the best window is counted token by token. The four masks together hit every window of 16 tokens with up to three
substitutions, and every one of 20 with up to four. Items shorter than a window are also hashed by three tokens in a
row, which finds them with every fifth token substituted; items under eight tokens must be equal throughout.

The benchmark's table is broadcast in blocks of about BLOCK_TOKENS tokens. A benchmark of one block is met in the scan
that returns the rows. A larger one takes a pass over the texts for each block, one after another: neither the driver
nor a worker holds more than one block, and what a pass finds is written down by text before the next one starts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, cut, forget, gram_hashes, lower_ascii, pieces, table

#: The token positions that each mask looks at.
MASKS = ((0, 2, 3, 7, 8, 9), (0, 1, 2, 4, 5, 8), (0, 2, 4, 7, 8, 10), (0, 1, 2, 4, 5, 6))
#: The mask of items shorter than a window, which the others do not fit often enough.
SHORT_MASK = (0, 1, 2)
#: Tokens of a verified window, the share of them that must be equal, the fewest tokens of an item that can be evidence,
#: and those from which a token may differ.
WINDOW, SIMILARITY, LEAST_TOKENS, TOLERANT_TOKENS = 16, 0.8, 4, 8
#: Tokens of the benchmark in one broadcast block (some 100 MB of tables on each worker at most).
BLOCK_TOKENS = 1_000_000
#: Cells (diagonals times item tokens) verified at a time.
CELLS = 2_000_000
#: Hits of seeds laid out at a time.
HITS = 1_000_000

#: Bytes as tokens see them: A-Z in lower case, ASCII that is no letter or digit as a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

OVERLAPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("item_start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_equal", T.LongType()),
        ]
    )
)
_OVERLAPS_PA = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "start", "item_start", "n_tokens", "n_equal")]))


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SeedTable:
    """The masked hashes of some items, sorted, and the items' tokens."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int, similarity: float, least: int) -> None:
        self.window, self.similarity = window, similarity
        words = WordHashes()
        kept = sorted((i, t) for i, text in items if i is not None and len(t := tokens(text)) >= least)
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.lengths = np.array([len(t) for _, t in kept], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        each = [words.of(t, len(t)) for _, t in kept]
        self.tokens = np.concatenate(each) if each else np.empty(0, np.uint64)
        short = [len(w) < window for w in each]
        self.masks = [*MASKS, *[SHORT_MASK] * any(short)]
        hashes, at = [], []
        for k, mask in enumerate(self.masks):
            for start, w, is_short in zip(self.starts, each, short, strict=True):
                if mask is SHORT_MASK and not is_short:
                    continue
                h = gram_hashes(w, mask, k)
                hashes.append(h)
                at.append(start + np.arange(len(h), dtype=np.int64))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int64))[order]
        self.bits = max(16, int(len(h) * 8).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def needed(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of an item's window, and how many must be equal."""
        wide = np.minimum(length, self.window)
        return wide, np.where(length < TOLERANT_TOKENS, wide, np.ceil(wide * self.similarity - 1e-9)).astype(np.int64)

    def overlaps(self, text: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, start, item_start, n_tokens, n_equal), the best window of every row and item that share one.

        ``text``: the tokens of all rows on end; a row's lie from ``first`` to ``end``.
        """
        if not len(self.hashes) or not len(text):
            return []
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        most = int(self.lengths.max())
        step = max(1, CELLS // most)
        # a diagonal as one number: what an item may begin before the text, and the item above the place
        span = len(text) + most
        known = np.empty(0, np.int64)
        for k, mask in enumerate(self.masks):
            h = gram_hashes(text, mask, k)
            at = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            # a seed that many items share is laid out in parts, each of at most HITS hits or one place's
            part = np.cumsum(n) // HITS
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(n)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True) if len(n) else ():
                m = n[a:b]
                hit = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                place = self.at[hit]
                item = np.searchsorted(self.starts, place, "right") - 1
                diagonals = np.unique(item * span + np.repeat(at[a:b], m) - (place - self.starts[item]) + most)
                # what an earlier mask or part has shown is not looked at again; only the last ones are remembered
                diagonals = diagonals[~np.isin(diagonals, known, assume_unique=True)]
                known = diagonals if len(known) > HITS else np.union1d(known, diagonals)
                for i in range(0, len(diagonals), step):
                    some = diagonals[i : i + step]
                    self._verify(some // span, some % span - most, text, first, end, best)
        return [(row, int(self.ids[item]), *x) for (row, item), x in sorted(best.items())]

    def _verify(self, item, base, text, first, end, best) -> None:
        """Lay each item beside the text at ``base`` and keep the windows that are alike."""
        length = self.lengths[item]
        ends = np.cumsum(length)
        cell = np.arange(ends[-1]) - np.repeat(ends - length, length)
        at = np.repeat(base, length) + cell
        inside = np.clip(at, 0, len(text) - 1)
        equal = (text[inside] == self.tokens[np.repeat(self.starts[item], length) + cell]) & (at == inside)
        total = np.concatenate([[0], np.cumsum(equal)])
        wide, least = self.needed(length)
        span = np.repeat(wide, length)
        open_ = cell + span <= np.repeat(length, length)
        score = np.where(open_, total[np.minimum(np.arange(ends[-1]) + span, ends[-1])] - total[:-1], -1)
        for j in np.flatnonzero(np.maximum.reduceat(score, ends - length) >= least):
            cells = score[ends[j] - length[j] : ends[j]]
            # the window may reach over the end of its row into the next one: look again within each row
            for c in np.flatnonzero(cells >= least[j]):
                lo = base[j] + c
                row = int(np.searchsorted(first, lo + wide[j] // 2, "right")) - 1
                a, b = max(lo, first[row]), min(lo + wide[j], end[row])
                n = int(equal[ends[j] - length[j] + c : ends[j] - length[j] + c + wide[j]][a - lo : b - lo].sum()) if b > a else 0
                if n < least[j]:
                    continue
                x = (int(a - first[row]), int(c + a - lo), int(wide[j]), n)
                old = best.get((row, int(item[j])))
                if old is None or (-x[3], x[0], x[1]) < (-old[3], old[0], old[1]):
                    best[row, int(item[j])] = x


def _scan(seeds, n_kept: int, only_hits: bool):
    """Texts (the column ``text`` of the last input column, a struct, or that column itself) to their overlaps with one block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = SeedTable(*seeds.value), WordHashes()
        for batch in pieces(batches):
            last = batch.column(batch.num_columns - 1)
            texts = last.field(last.type.get_field_index("text")) if pa.types.is_struct(last.type) else last
            each = [tokens(t) for t in texts.cast(pa.string()).cast(pa.binary()).to_pylist()]
            n = np.array([len(t) for t in each], np.int64)
            end = np.cumsum(n)
            text = words.of((w for t in each for w in t), int(n.sum()))
            found: list[list[dict]] = [[] for _ in each]
            full = np.flatnonzero(n)
            for row, *x in known.overlaps(text, (end - n)[full], end[full]):
                found[full[row]].append(dict(zip(("item_id", "start", "item_start", "n_tokens", "n_equal"), x, strict=True)))
            for x in found:
                x.sort(key=lambda o: o["item_id"])
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], pa.array(n), pa.array(found, _OVERLAPS_PA)], [*batch.schema.names[:n_kept], "n_tokens", "overlaps"]
            )
            yield out.filter(pa.array([bool(x) for x in found])) if only_hits else out

    return scan


def spaced_seed_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    least_tokens: int = LEAST_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Every row of ``docs`` as column ``row`` (a struct of all its columns), with ``n_tokens`` and its ``overlaps``.

    docs has a column text, benchmark has item_id and text. Tokens are runs of ASCII letters (A-Z as a-z), digits and
    non-ASCII characters. An overlap is the best window of an item in the text: ``n_tokens`` tokens (``window``, or the
    whole of a shorter item), of which ``n_equal``, at least ``similarity`` of them, are equal place by place; an item
    under eight tokens must be equal throughout. Overlaps are listed by item_id; of equally good windows the first is
    given. Null or empty texts have none; items of fewer than ``least_tokens`` tokens or without an id are no evidence
    and match nothing; items that repeat an id count once for each text; empty tables give no rows or no overlaps.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    blocks = max(1, int(-(-total // block_tokens)))

    def seeds(block: int):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        return context.broadcast(([(i, bytes(t)) for i, t in own.collect()], window, similarity, least_tokens))

    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if blocks == 1:
        out = T.StructType([wrapped.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("overlaps", OVERLAPS)])
        return wrapped.mapInArrow(_scan(seeds(0), 1, False), out)

    key = [F.xxhash64("text").alias("h1"), F.md5(F.col("text").cast("string")).alias("h2")]
    texts = docs.where("text IS NOT NULL").select(*key, F.col("text").cast("string"))
    out = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("overlaps", OVERLAPS)])
    found = []
    for block in range(blocks):
        shared = seeds(block)
        found.append(cut(texts.mapInArrow(_scan(shared, 2, True), out).distinct(), "block-overlaps"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, found).groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("overlaps"))).alias("overlaps"))
    every = cut(every, "overlaps")
    forget(*found)
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(every, ["h1", "h2"], "left")
    text = lower_ascii(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return rows.select("row", F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_tokens"), F.coalesce("overlaps", F.array().cast(OVERLAPS)).alias("overlaps"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item of the benchmark, all columns as they were."""
    return spaced_seed_overlaps(docs, benchmark).where(F.size("overlaps") == 0).select("row.*")


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark: one row for each, with the items found in it; kept: none was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spaced_seed_overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_tokens",
        F.size("overlaps").cast("long").alias("n_items"),
        F.array_join(F.transform("overlaps", lambda o: o["item_id"].cast("string")), ",").alias("item_ids"),
        F.array_max(F.transform("overlaps", lambda o: o["n_equal"] / o["n_tokens"])).alias("best_similarity"),
        (F.size("overlaps") == 0).alias("kept"),
    )
