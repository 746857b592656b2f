"""Quality rules and robust multivariate outliers.

Two plain rules come first (too few words, too much repetition). The texts that pass them become vectors of six
transformed statistics, and for every language and source a minimum-covariance-determinant estimate (MCD) of centre and
scatter is fitted to all their vectors: the three fifths of the rows that lie closest together. Rows at a large
Mahalanobis distance from it are rejected.

Every source has an estimate of its own. One of few rows is drawn towards that of its language, and a language of few
rows towards that of all, as if PRIOR rows of the wider group had been added: there is no size from which a group is
treated otherwise. Most clean texts are equal in some statistics (no symbol, no repeated line), where an estimate is
flat; so the statistics' own resolution, what one symbol or one repeated line makes, is added to every scatter as
independent noise (see RESOLUTION). It never takes the scatter's place: both are summed.

The fit is distributed. A concentration step scores all rows against the estimates of their groups, finds each group's
quantile from a histogram of distances (counts of fixed logarithmic buckets, combined before the shuffle), and sums
the moments of the rows within it, so neither a task nor the driver ever holds a group's rows. Two starts (medians with
the quartiles' spread, and medians with the resolution alone) run side by side until determinants hardly change any
more; the one that ends with the smaller determinant wins and is reweighted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, cut, forget, gram_hashes, pieces, table

#: The statistics: log mean word length, and square roots of symbols, punctuation and capitals per letter, repeated
#: words and repeated lines.
STATISTICS = ("word_length", "symbols", "punctuation", "capitals", "repeats", "lines")
#: What one count more makes of each in a text of 300 letters: a letter more in every hundred, a symbol where there is none
#: (the root of 1/300), a mark or a capital beside the usual ones; and one word or line in a hundred that is repeated.
RESOLUTION = (0.01, 0.06, 0.01, 0.013, 0.10, 0.10)
P = len(STATISTICS)
#: The share of rows that an estimate rests on, the most concentration steps (few are needed), the rows that a wider group
#: counts for, and the distance (squared, the 0.999 quantile of a chi-square of six degrees) from which a row is an outlier.
SHARE, MOST_STEPS, PRIOR, CUTOFF = 0.6, 10, 30, 22.46
#: The mean change of a determinant's logarithm from which another step is taken.
LEAST_CHANGE = 1e-3
#: Fewest words, and the largest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATS = 50, 50

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _chi2(x: float, even: int) -> float:
    """Cumulative chi-square of an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(even // 2))


def _quantile(q: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, P) < q else (lo, mid)
    return lo


def _consistency(q: float) -> float:
    """By what the scatter of the innermost share q falls short."""
    return q / _chi2(_quantile(q), P + 2)


def text_statistics(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    if n >= 3:
        grams = gram_hashes(hashes.of(words, n), (0, 1, 2), 31)
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if same.any():
            twice = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for i in range(3):
                twice[at + i] = True
            repeats = int(twice.sum())
    size = max(chars, 1)
    share = lambda x: math.sqrt(x / size)
    vector = [
        math.log(size / max(n, 1)),
        share(symbols),
        share(len(raw) - len(raw.translate(None, _PUNCTUATION))),
        share(len(raw) - len(raw.translate(None, _UPPER))),
        math.sqrt(repeats / max(n, 1)),
        math.sqrt(dup_lines / max(len(lines), 1)),
    ]
    return n, chars, symbols, dup_lines, repeats, vector


def _scan(least_words: int, most_repeats: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            rows = [text_statistics(t, hashes) for t in batch.column(1).to_pylist()]
            failed = [r[0] < least_words or 100 * r[4] > most_repeats * r[0] for r in rows]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            vectors = pa.array([None if f else r[5] for r, f in zip(rows, failed, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *counts, pa.array(failed, pa.bool_()), vectors],
                ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "x"],
            )

    return scan


def _levels() -> Column:
    """A row's groups with the next wider one of each: all, the language, the source in the language."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    every, language, source = F.lit("{}"), name("lang"), name("lang", "source")
    pairs = ((every, F.lit("")), (language, every), (source, language))
    return F.array(*[F.struct(g.alias("group"), p.alias("parent")) for g, p in pairs])


def _distance(x: Column, centre: Column, precision: Column) -> Column:
    d = [F.get(x, F.lit(i)) - F.get(centre, F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + d[i] * d[j] * F.get(precision, F.lit(k)) * (1.0 if i == j else 2.0)
    return total


def _bucket(d2: Column) -> Column:
    """64 buckets for every doubling of a distance."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * 64).cast("int")


def _precision(scatter: np.ndarray) -> tuple[list[float], float]:
    """The inverse of a scatter with the statistics' resolution, and the logarithm of its determinant."""
    whole = scatter + np.diag(np.square(RESOLUTION))
    inverse = np.linalg.inv(whole)
    return [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(whole)[1])


def _square(pairs) -> np.ndarray:
    m = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, pairs, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _drawn(levels: list[tuple], factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the last of ``levels`` (n, sums, sums of products; widest first), drawn towards the wider ones."""
    centre = scatter = None
    for n, total, products in levels:
        mean = np.array(total) / n
        own = (_square(products) / n - np.outer(mean, mean)) * factor
        share = 1.0 if centre is None else n / (n + PRIOR)
        centre = mean if centre is None else share * mean + (1 - share) * centre
        scatter = own if scatter is None else share * own + (1 - share) * scatter
    return centre, scatter


_ESTIMATE = "group string, parent string, start int, centre array<double>, precision array<double>, logdet double"


def _with_wider(moments: DataFrame) -> DataFrame:
    """Moments (group, parent, start, n, s, ss) of every group beside those of the two wider ones; one row for each group and start."""
    wider = [moments.select(F.col("group").alias(f"g{k}"), F.col("parent").alias(f"p{k}"), F.col("start").alias(f"t{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "s", "ss")]) for k in (1, 2)]
    out = moments.join(wider[0], (F.col("parent") == F.col("g1")) & (F.col("start") == F.col("t1")), "left")
    return out.join(wider[1], (F.col("p1") == F.col("g2")) & (F.col("start") == F.col("t2")), "left").drop("g1", "t1", "p1", "g2", "t2", "p2")


def _chain(r) -> list[tuple]:
    return [(n, s, ss) for n, s, ss in ((r.n2, r.s2, r.ss2), (r.n1, r.s1, r.ss1), (r.n, r.s, r.ss)) if s is not None]


def _estimates(moments: DataFrame, factor: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                centre, scatter = _drawn(_chain(r), factor)
                out.append((r.group, r.parent, r.start, [float(c) for c in centre], *_precision(scatter)))
            yield pd.DataFrame(out, columns=["group", "parent", "start", "centre", "precision", "logdet"])

    return _with_wider(moments).mapInPandas(run, _ESTIMATE)


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.get("x", F.lit(i)) for i in range(P)]
    sums = rows.groupBy("group", "parent", "start").agg(
        F.count("*").alias("n"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS],
    )
    return sums.select("group", "parent", "start", "n", F.array(*[f"s{i}" for i in range(P)]).alias("s"), F.array(*[f"s{i}_{j}" for i, j in _PAIRS]).alias("ss"))


def _quantiles(vectors: DataFrame) -> DataFrame:
    """(group, parent, q): for each statistic its median m and the quartiles' distance w."""
    step = 512
    cells = vectors.select("group", "parent", F.posexplode("x").alias("i", "v")).groupBy(
        "group", "parent", "i", F.floor(F.col("v") * step).cast("int").alias("b")
    ).agg(F.count("*").alias("n"))
    w = W.partitionBy("group", "parent", "i")
    cells = cells.withColumn("below", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") >= F.col("all") * q, F.col("b"))) / step
    found = cells.groupBy("group", "parent", "i").agg(at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("w"))
    return found.groupBy("group", "parent").agg(F.array_sort(F.collect_list(F.struct("i", "m", "w"))).alias("q"))


def _starts(quantiles: DataFrame) -> DataFrame:
    """Both starts of every group: the medians, with the quartiles' distance (0) or nothing (1) as scatter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                centre = [float(q["m"]) for q in r.q]
                for start, sd in enumerate(([q["w"] / 1.349 for q in r.q], [0.0] * P)):
                    out.append((r.group, r.parent, start, centre, *_precision(np.diag(np.square(sd)))))
            yield pd.DataFrame(out, columns=["group", "parent", "start", "centre", "precision", "logdet"])

    return quantiles.mapInPandas(run, _ESTIMATE)


def mcd_estimates(vectors: DataFrame, share: float = SHARE, most_steps: int = MOST_STEPS) -> DataFrame:
    """(group, centre, precision) of the vectors (group, parent, x array of six); parent: the next wider group, or ''."""
    now, before = cut(_starts(_quantiles(vectors)), "mcd-start"), None
    for _ in range(most_steps):
        guess = now.drop("parent", "logdet")
        scored = vectors.join(guess, "group").select("group", "parent", "start", "x", _bucket(_distance(F.col("x"), F.col("centre"), F.col("precision"))).alias("b"))
        counts = scored.groupBy("group", "start", "b").agg(F.count("*").alias("n"))
        w = W.partitionBy("group", "start")
        counts = counts.withColumn("below", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
        edge = counts.where(F.col("below") >= F.ceil(F.col("all") * share)).groupBy("group", "start").agg(F.min("b").alias("edge"))
        edge = cut(edge, "mcd-edge")
        inner = scored.join(edge, ["group", "start"]).where("b <= edge")
        last, now = now, cut(_estimates(_moments(inner), _consistency(share)), "mcd-step")
        forget(last, edge)
        state, n = now.agg(F.sum(F.round("logdet", 6)), F.count("*")).first()
        if state is None or (before is not None and abs(state - before) < LEAST_CHANGE * n):
            break
        before = state
    best = now.groupBy("group").agg(F.min_by(F.struct("start", "centre", "precision"), F.struct("logdet", "start")).alias("e"))
    best = cut(best.select("group", "e.*"), "mcd-best")
    inner = vectors.join(best, "group").where(_distance(F.col("x"), F.col("centre"), F.col("precision")) <= _quantile(0.975))
    inner = inner.select("group", "parent", F.lit(0).alias("start"), "x")
    last = _estimates(_moments(inner), _consistency(0.975)).select("group", F.struct("centre", "precision").alias("last"))
    # a small group may have no row near the estimate that it was drawn to
    last = best.join(last, "group", "left").select("group", F.coalesce("last", F.struct("centre", "precision")).alias("e"))
    last = cut(last.select("group", "e.*"), "mcd")
    forget(now, best)
    return last


def quality_rules(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    most_repeats: int = MOST_REPEATS,
    cutoff: float = CUTOFF,
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang, source), with its statistics and the verdict.

    Returns doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, group (the
    language and source as JSON), distance (squared Mahalanobis distance, null if base_failed) and kept. A null text
    counts as empty and fails the base rules; a null language or source is a group like any other; a row without others
    is kept. An empty table gives no rows; other columns are ignored.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = (
        f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, lang string, source string, n_words long, word_chars long, "
        "n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, x array<double>"
    )
    rows = cut(plain.mapInArrow(_scan(least_words, most_repeats), schema), "statistics")
    rows = rows.withColumn("levels", _levels())
    vectors = rows.where("x IS NOT NULL").select(F.inline("levels"), "x")
    estimates = mcd_estimates(vectors).withColumnRenamed("group", "_group")
    rows = rows.withColumn("group", F.get("levels", F.lit(2))["group"])
    rows = rows.join(estimates, F.col("group") == F.col("_group"), "left")
    rows = rows.withColumn("distance", F.when(F.col("x").isNotNull(), _distance(F.col("x"), F.col("centre"), F.col("precision"))))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "group", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def op2_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the base rules and the robust distance within their language and source."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
