"""Ranked lexical search by a bit-sliced impact index.

What a term adds to a document's score, its impact, is a whole number that index time knows: the term's weight times
the saturated frequency. Documents are dealt to blocks, and in a block every term has its documents (slots) and one
bitmap for each bit of their impacts: slice b holds bit b of all of them, side by side.

A query adds the slices of its terms as numbers are added by hand, but for all documents of a block at once: three
summands become two (sum and carry bits) by AND, OR and XOR of whole slices, and the last two are added with a rippling
carry. The best k documents are then read off the sum from its most significant slice down: as long as a slice leaves
more than k candidates, those without the bit go; where it leaves fewer, those with the bit are in and the rest compete
on. Ties that are left at the end go to the smallest ids, as slots are in the order of ids. The best of every block are
ranked together at last.

The index is a table (block, term, slots, slices, ids) of one row for each term of a block, and one for the block's
documents; queries are taken in batches of bounded size, each batch reads the index once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, forget, lower_ascii, pieces, table

#: A term: a run of ASCII letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a block, and the most documents of one.
BLOCK_POSTINGS, BLOCK_DOCS = 300_000, 16_384
#: Distinct terms up to which a vocabulary is broadcast (some 50 bytes each), and terms of a batch of queries.
BROADCAST_TERMS, BATCH_TERMS = 1_000_000, 200_000
#: Bits of an impact; sums are as much longer as they need.
BITS = 40
#: Where rows without a doc_id stand in the order of ids.
_LAST = (1 << 63) - 1

_POSTING = "doc_id long, version long, n long, terms array<string>, tfs array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(TERM).findall
    for batch in pieces(batches):
        n, terms, tfs = [], [], []
        for text in batch.column(2).to_pylist():
            counts = Counter(find(text or ""))
            n.append(counts.total())
            terms.append(["", *counts]), tfs.append([1, *counts.values()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
            ["doc_id", "version", "n", "terms", "tfs"],
        )


def _of_vocabulary(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` with what the distinct terms of ``vocabulary`` say; that side is broadcast up to a counted size."""
    small = vocabulary.count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(vocabulary) if small else vocabulary.hint("merge"), "term")


def postings(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, n, term, tf) of all documents; each has a row with the empty term. n: its terms with repeats.

    A vocabulary has distinct terms, the empty one among them.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), lower_ascii(F.col("text").cast("string")).alias("text"))
    rows = plain.mapInArrow(_scan, _POSTING).select("doc_id", "version", "n", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
    return rows if vocabulary is None else _of_vocabulary(rows, vocabulary)


def _weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2) / (2 * df + 1))).cast("long")


def slices_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers to BITS rows of packed bits, the least significant first."""
    return np.packbits((values[None, :] >> np.arange(BITS, dtype=np.int64)[:, None]) & 1, axis=1, bitorder="little")


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """One block (block, id, unnamed, version, term, impact) to its rows of the index; slots are in the order of ids."""
    docs = frame[["id", "unnamed", "version"]].drop_duplicates().sort_values(["id", "unnamed", "version"], ignore_index=True)
    slot = docs.assign(slot=docs.index).merge(frame[["id", "unnamed", "version"]], how="right")["slot"].to_numpy()
    frame = frame.assign(slot=slot)
    copies = np.bincount(slot[(frame["term"] == "").to_numpy()], minlength=len(docs))
    rows = frame[frame["term"] != ""].drop_duplicates(["term", "slot"]).sort_values(["term", "slot"])
    at, values = rows["slot"].to_numpy(np.int32), rows["impact"].to_numpy(np.int64)
    terms = rows["term"].to_numpy()
    edges = np.append(np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else [], len(terms)).astype(int)
    out = [
        (terms[a], at[a:b].tobytes(), slices_of(values[a:b]).tobytes())
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]
    ids = [None if none else d for d, none in zip(docs["id"].tolist(), docs["unnamed"], strict=True)]
    # the empty term carries the block's documents
    out.append(("", np.array(copies, np.int32).tobytes(), b""))
    found = pd.DataFrame(out, columns=["term", "slots", "slices"])
    found.insert(0, "block", frame["block"].iloc[0])
    found["ids"] = [None] * (len(out) - 1) + [ids]
    return found


_INDEX = "block long, term string, slots binary, slices binary, ids array<long>"


def impact_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The index of ``docs`` (doc_id long, text): (block, term, slots, slices, ids), written to the shared folder.

    Every document is indexed, under all its terms or those of ``vocabulary`` (term); frequencies, lengths and their
    means are those of all documents and terms in any case. The row with the empty term holds a block's documents: ids
    by slot, and in slots how often each is there (rows that repeat a doc_id and text share a slot).
    """
    if vocabulary is not None:
        vocabulary = cut(vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([("",)], "term string")).distinct(), "vocabulary")
    rows = cut(postings(docs, vocabulary), "postings")
    if vocabulary is not None:
        forget(vocabulary)
    own = F.col("term") == ""
    sizes = rows.agg(
        F.count_if(own & (F.col("n") > 0)).alias("n_docs"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n_terms"), F.count("*").alias("rows"), F.count_if(own).alias("all")
    ).first()
    weights = rows.where(~own).groupBy("term").agg(F.count("*").alias("df")).select("term", _weight(F.lit(sizes.n_docs), F.col("df")).alias("w"))
    weights = cut(weights, "weights")
    m = 25 + F.expr(f"(75 * n * {sizes.n_docs}) div {max(sizes.n_terms, 1)}")
    rows = rows.withColumn("m", m.cast("long"))
    scored = _of_vocabulary(rows, weights).withColumn("impact", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))"))
    blocks = max(1, -(-sizes.rows // BLOCK_POSTINGS), -(-sizes.all // BLOCK_DOCS))
    block = F.pmod(F.xxhash64("doc_id", "version"), F.lit(blocks)).alias("block")
    doc = [block, F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.isnull("doc_id").alias("unnamed"), "version", "term"]
    both = scored.select(*doc, "impact").unionByName(rows.where(own).select(*doc, F.lit(0).cast("long").alias("impact")))
    index = cut(both.groupBy("block").applyInPandas(_build, _INDEX), "impact-index")
    forget(rows, weights)
    return index


def add(numbers: list[np.ndarray]) -> np.ndarray:
    """The sum of bit-sliced numbers (bits x words), by carry-save steps and one rippling carry."""
    bits = BITS + max(1, len(numbers)).bit_length()
    queue = [np.vstack([x, np.zeros((bits - len(x), x.shape[1]), x.dtype)]) for x in numbers]
    while len(queue) > 2:
        a, b, c, *queue = queue
        half = a ^ b
        carry = np.zeros_like(a)
        carry[1:] = ((a & b) | (half & c))[:-1]
        queue += [half ^ c, carry]
    if len(queue) == 1:
        return queue[0]
    (a, b), carry = queue, np.zeros_like(queue[0][0])
    total = np.empty_like(a)
    for i in range(bits):
        half = a[i] ^ b[i]
        total[i], carry = half ^ carry, (a[i] & b[i]) | (half & carry)
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top(total: np.ndarray, k: int, weight=_count) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents that are surely among the k best of a bit-sliced sum, and of those tied for the rest."""
    sure = np.zeros_like(total[0])
    open_ = np.bitwise_or.reduce(total, axis=0)  # nothing with a score of zero
    for bits in total[::-1]:
        having = open_ & bits
        n = weight(sure | having)
        if n > k:
            open_ = having
        elif n < k:
            sure, open_ = sure | having, open_ & ~bits
        else:
            return sure | having, np.zeros_like(sure)
    return sure, open_


class Block:
    """The terms of a block that a batch of queries asks for."""

    def __init__(self) -> None:
        self.terms: dict[str, tuple[bytes, bytes]] = {}
        self.ids: list = []
        self.copies = np.empty(0, np.int32)

    def number(self, term: str) -> np.ndarray | None:
        """A term's impacts as slices over all slots of the block."""
        if term not in self.terms:
            return None
        slots, slices = self.terms[term]
        at = np.frombuffer(slots, np.int32)
        bits = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(BITS, -1), axis=1, count=len(at), bitorder="little")
        wide = np.zeros((BITS, -(-len(self.ids) // 64) * 64), np.uint8)
        wide[:, at] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def best(self, terms: dict[str, int], k: int) -> Iterator[tuple[int | None, int]]:
        """(doc_id, score) of the k best documents; a term that a query repeats counts as often."""
        numbers = [x for t, times in terms.items() if (x := self.number(t)) is not None for _ in range(times)]
        if not numbers:
            return
        total = add(numbers)
        sure, tied = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in top(total, k))
        chosen = np.concatenate([sure, tied[: max(0, k - len(sure))]])
        bits = np.unpackbits(total.view(np.uint8), axis=1, bitorder="little")[:, chosen].astype(np.int64)
        scores = (bits << np.arange(len(bits), dtype=np.int64)[:, None]).sum(axis=0)
        for slot, score in zip(chosen.tolist(), scores.tolist(), strict=True):
            for _ in range(min(k, int(self.copies[slot]))):
                yield self.ids[slot], score


def _search(queries: dict[int, dict[str, int]], k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(), []
        for term, slots, slices, ids in zip(frame["term"], frame["slots"], frame["slices"], frame["ids"], strict=True):
            if term:
                block.terms[term] = (slots, slices)
            else:
                block.ids, block.copies = list(ids), np.frombuffer(slots, np.int32)
        for item, terms in queries.items():
            out += [(item, d, s) for d, s in block.best(terms, k)]
        return pd.DataFrame(out, columns=["item", "doc_id", "score"])

    return run


def _batches(items: DataFrame, size: int) -> Iterator[dict[int, dict[str, int]]]:
    """The items (item, term, times) in turn, so many terms at a time that the driver holds ``size`` of them and one item more."""
    rows = items.orderBy("item").toLocalIterator()
    now: dict[int, dict[str, int]] = defaultdict(dict)
    held = 0
    for r in rows:
        if held >= size and r.item not in now:
            yield dict(now)
            now, held = defaultdict(dict), 0
        now[r.item][r.term] = r.times
        held += 1
    if now:
        yield dict(now)


def _question_terms(queries: DataFrame) -> DataFrame:
    """(item, term, times) of queries (item, text)."""
    found = F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(f"({TERM})"), F.lit(1))
    return queries.select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count("*").cast("int").alias("times"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` highest-scoring documents of each of ``queries`` (item long, text).

    Scores of zero are no results; equal scores are ranked by doc_id, rows without one last. Queries that repeat an item
    are asked as one text; null texts have no terms.
    """
    items = cut(_question_terms(queries), "question-terms")
    terms = index.sparkSession
    found = None
    for batch in _batches(items, batch_terms):
        vocabulary = terms.createDataFrame([(t,) for t in {"", *(t for q in batch.values() for t in q)}], "term string")
        asked = index.join(F.broadcast(vocabulary), "term", "left_semi")  # a batch's terms: bounded by batch_terms
        part = cut(asked.groupBy("block").applyInPandas(_search(batch, k), "item long, doc_id long, score long"), "best-of-blocks")
        found = part if found is None else found.unionByName(part)
    forget(items)
    if found is None:
        found = index.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id long, text) for each of ``queries`` (item, text): item, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case; see ``impact_index`` and ``search``.
    A null text has no terms. Rows that repeat a doc_id are documents of their own. An empty table of either kind gives
    no rows; other columns are ignored.
    """
    queries = queries.select(F.col("item").cast("long").alias("item"), "text")
    index = impact_index(docs, _question_terms(queries).select("term").distinct())
    found = search(index, queries, k)
    forget(index)  # every batch's best are written down
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = lexical_search(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL
), whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, docs
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM items GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
