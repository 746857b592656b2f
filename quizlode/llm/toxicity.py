"""Toxicity by multiple-instance learning.

Only documents carry labels, so a document is a bag of sentences: each sentence gets a probability from the words and
word beginnings in it, and the document is toxic unless all its sentences are harmless (noisy-or). The sentence weights
are learned from document labels through that combination, and the same sentence scores then locate what offends.

Fitting takes at most MOST_LABELS labelled documents of MOST_BYTES of text (documented bounds; which ones depends on a
hash of their ids alone), whole texts each. Scoring is one scan without a shuffle; a worker scores each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, cut, forget, pieces, table

#: Labelled documents to fit on, features kept, and the score from which a document counts as toxic.
MOST_LABELS, MOST_FEATURES, THRESHOLD = 6_000, 4_000, 0.7
#: Bytes of text to fit on, all together.
MOST_BYTES = 32 << 20
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature needs so many documents of a label, and to differ so many standard errors between the labels.
LEAST_DOCS, LEAST_Z = 3, 3.5

SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")

OFFENDING = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
)
_OFFENDING_PA = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


class Model(dict):
    """Weights of features; as a dict, what each word adds to its sentence."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def score(self, text: str | None, least: float) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and the sentences (start, end, score) that score ``least`` or more."""
        harmless, found = 0.0, []
        if not self.weights:
            return 0.0, found
        base = np.log1p(np.exp(self.bias))
        for m in SENTENCE.finditer(text or ""):
            x = sum(map(self.__getitem__, _WORD.findall(m[0].lower())))
            if x == 0.0:
                harmless += base
                continue
            x = min(x + self.bias, 30.0)
            harmless += np.log1p(np.exp(x))
            if (p := 1 / (1 + np.exp(-x))) >= least:
                found.append((*m.span(), float(p)))
        return float(-np.expm1(-harmless)), found


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (text, toxic) to features with the number of harmless and toxic documents that have them."""
    for batch in pieces(batches):
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for m in SENTENCE.finditer(text or "") for w in _WORD.findall(m[0].lower())}
            seen[label].update({f for w in words for f in features(w)})
        names = list(seen[0] | seen[1])
        found = [pa.array([s[f] for f in names], pa.int64()) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *found], ["feature", "harmless", "toxic"])


class _Columns(dict):
    """As a dict, the columns of a word's telling features."""

    def __init__(self, chosen: dict[str, int]) -> None:
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = [self.chosen[f] for f in features(word) if f in self.chosen]
        return value


def _bags(chosen: dict[str, int]):
    """Documents (doc_id, text, toxic) to how many columns each of their sentences has, which, and how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = _Columns(chosen)
        for batch in pieces(batches):
            sizes, columns, times = [], [], []
            for text in batch.column(1).to_pylist():
                own = [sorted(Counter(c for w in _WORD.findall(m[0].lower()) for c in columns_of[w]).items()) for m in SENTENCE.finditer(text or "")]
                sizes.append([len(x) for x in own])
                columns.append([c for x in own for c, _ in x]), times.append([n for x in own for _, n in x])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (sizes, columns, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["doc_id", "toxic", "sizes", "columns", "times"])

    return scan


def fit(texts: DataFrame, rounds: int = 400, ridge: float = 0.02) -> Model:
    """Learn sentence weights from texts (doc_id, text, toxic) by gradient steps on the noisy-or likelihood.

    Features are counted and chosen by Spark; the driver gets the columns of the sentences, no text.
    """
    n = dict(texts.groupBy("toxic").count().collect())
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    if not n0 or not n1:
        return Model({}, 0.0)
    a, b = F.col("toxic"), F.col("harmless")
    share = (a + b) / F.lit(n0 + n1)
    z = F.abs((a / F.lit(n1) - b / F.lit(n0)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * F.lit(1 / n0 + 1 / n1)))
    seen = texts.select("text", "toxic").mapInArrow(_seen, "feature string, harmless long, toxic long")
    seen = seen.groupBy("feature").agg(F.sum("harmless").alias("harmless"), F.sum("toxic").alias("toxic")).withColumn("z", z)
    telling = seen.where((F.greatest(a, b) >= LEAST_DOCS) & (F.col("z") >= LEAST_Z))
    chosen = {f: k for k, (f,) in enumerate(telling.orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).select("feature").collect())}
    kind = texts.schema["doc_id"].dataType.simpleString()
    bags = texts.select("doc_id", "text", "toxic").orderBy("doc_id")
    bags = bags.mapInArrow(_bags(chosen), f"doc_id {kind}, toxic int, sizes array<int>, columns array<int>, times array<int>").toArrow()
    y, sizes, column, value = (bags[c].combine_chunks() for c in ("toxic", "sizes", "columns", "times"))
    bag = np.repeat(np.arange(len(y), dtype=np.int32), sizes.value_lengths().to_numpy())
    sentence = np.repeat(np.arange(len(bag), dtype=np.int32), sizes.flatten().to_numpy())
    y, column, value = y.to_numpy().astype(float), column.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float32)
    w, bias = np.zeros(len(chosen)), -4.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for k in range(1, rounds + 1):
        x = np.clip(np.bincount(sentence, w[column] * value, len(bag)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-x))
        harmless = np.bincount(bag, np.log1p(np.exp(x)), len(y))
        toxic = np.clip(-np.expm1(-harmless), 1e-9, 1)
        # d loss / d x of a sentence: p for a harmless document, p times (1 - 1 / toxic) for a toxic one
        slope = p * np.where(y == 1, 1 - 1 / toxic, 1.0)[bag]
        g = np.append(np.bincount(column, slope[sentence] * value, len(chosen)) + ridge * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], float(bias - step[-1])
    return Model({f: float(w[i]) for f, i in chosen.items()}, bias)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, most_bytes: int = MOST_BYTES) -> Model:
    """A model of labels (doc_id, toxic) on the texts of docs (doc_id, text); rows that are held out take no part.

    Labels without an id, a value or a document are ignored; of labels that repeat an id the largest counts. Of the rest
    at most ``most_labels`` take part, in the order of a hash of their ids, and as many of them as have ``most_bytes`` of
    text together (a text of more than a sixteenth of that takes no part). Without labels of both kinds the model has no
    weights and scores everything 0.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size"))
    usable = usable.join(sizes, "doc_id").where(F.col("size") <= most_bytes // 16)
    rank = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")))
    sample = usable.select("doc_id", "toxic", "size", rank.alias("rank")).orderBy("rank", "doc_id").limit(most_labels)
    sample = sample.withColumn("total", F.sum("size").over(W.orderBy("rank", "doc_id"))).where(F.col("total") <= most_bytes)  # most_labels rows
    sample = cut(sample.select("doc_id", "toxic"), "label-sample")
    # at most most_labels rows of an id and a number; of texts that repeat an id the smallest hash stands for all
    text = F.min_by("text", F.xxhash64("text")).alias("text")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(text, F.max("toxic").alias("toxic"))
    texts = cut(texts.select("doc_id", "text", "toxic"), "label-texts")
    model = fit(texts)
    forget(sample, texts)
    return model


def score_toxicity(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Every row of ``docs`` as column ``row`` (a struct of all its columns), with ``score`` and ``offending``.

    offending lists the sentences (start, end in code points, score) that score ``least`` or more by themselves. A null
    or empty text scores 0 and has none, as has everything if the model saw labels of one kind only.
    """
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in pieces(batches):
            rows = batch.column(0)
            texts = rows.field(rows.type.get_field_index("text")).to_pylist()
            scores, found = [], []
            for text in texts:
                score, spans = known.score(text, least)
                scores.append(score)
                found.append([{"start": a, "end": b, "score": s} for a, b, s in spans])
            yield pa.RecordBatch.from_arrays([rows, pa.array(scores, pa.float64()), pa.array(found, _OFFENDING_PA)], ["row", "score", "offending"])

    out = T.StructType([wrapped.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("offending", OFFENDING)])
    return wrapped.mapInArrow(scan, out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that a model of the labels scores under ``threshold``, all columns as they were."""
    return score_toxicity(docs, learn(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
        F.get("offending", F.lit(0))["start"].alias("first_offending"),
    )
