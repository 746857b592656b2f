"""MinHash near-dedup with b-bit signatures.

Texts with equal shingle sets are folded into one class first, so copies cost one row each. Each class has 128 minima:
25 bands of five minima propose candidates, and the lowest four bits of every minimum are packed into eight longs from
which any pair's similarity is estimated by XOR and bit counts, corrected for chance collisions. A pair of similarity
0.85 misses all bands with a chance of 4e-7, and falls under the estimate's bound (five deviations lower) about as
rarely. What passes is confirmed on the full sets.

No bucket is ever expanded into all its pairs. First every member is compared with the smallest one of its bucket, and
the confirmed links are joined to components. Then only buckets that still hold more than one component are looked at
again: there each member outside the bucket's largest component is compared, by signature and inside the join, with the
members of the other components, large buckets in parts. Links inside one component can't change the result, and of the
links between two components one that the full sets confirm is enough.

Texts are joined with the ids that ask for them by sort-merge at every size: those ids grow with the corpus, so they
are no side to broadcast.

A class is compared by one text, that of its smallest doc_id, known by doc_id and version (a hash of the text): rows that
repeat it count once, and an id with several texts has a class, a place in the buckets and differences for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, forget, gram_hashes, mix, odd_constants, pieces, table
from .graph import connected_components

#: Minima of a signature, minima of a band, bits kept of each minimum.
MINIMA, ROWS, BITS = 128, 5, 4
#: By how much an estimate may lie below the similarity asked for.
MARGIN = 0.17
#: Members of a bucket that one task compares with those outside the largest component.
PART = 2048

_A = odd_constants(MINIMA, 11)
_B = odd_constants(MINIMA, 12)
_FEATURES = "doc_id long, version long, n_shingles long, class binary, signature array<long>, bands array<long>"
_DIFFERENCES = "u long, uversion long, v long, vversion long, linked boolean, hub_shingles long, missing array<long>, extra array<long>"


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; fewer words than ``size`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words, len(words)), tuple(range(min(size, len(words)))), 21))


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(best, (np.multiply.outer(_A, shingles[i : i + 2048]) + _B[:, None]).min(axis=1), out=best)
    return mix(best)


def packed(values: np.ndarray) -> np.ndarray:
    """BITS planes of MINIMA bits, as longs."""
    planes = (values >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8)).view(np.int64)


def band_hashes(values: np.ndarray) -> np.ndarray:
    n = MINIMA // ROWS
    rows = values[: n * ROWS].reshape(n, ROWS)
    return mix((rows * odd_constants(ROWS, 13)).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def _features(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            n, classes, signatures, bands = [], [], [], []
            for text in batch.column(2).cast(pa.string()).cast(pa.binary()).to_pylist():
                found = shingle_hashes(text.lower().split(), hashes, size) if text else ()
                n.append(len(found))
                if not len(found):
                    classes.append(None), signatures.append(None), bands.append(None)
                    continue
                classes.append(xxhash.xxh3_128_digest(found.tobytes()))
                values = minima(found)
                signatures.append(packed(values))
                bands.append(band_hashes(values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.array(signatures, pa.list_(pa.int64())),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "version", "n_shingles", "class", "signature", "bands"],
            )

    return scan


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures tell, corrected for lanes that are equal by chance."""
    words = MINIMA // 64
    unequal = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            i = F.lit(plane * words + w)
            differ = differ.bitwiseOR(F.get(a, i).bitwiseXOR(F.get(b, i)))
        unequal = unequal + F.bit_count(differ)
    chance = 1 / 2**BITS
    return (1 - unequal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def _confirm(size: int, similarity: float):
    share = round(similarity * 100)

    def shingles(text: bytes) -> set:
        words = text.lower().split()
        return set(zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else {tuple(words)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, set()
        for batch in pieces(batches):
            keep = []
            a, b = (batch.column(i).cast(pa.string()).cast(pa.binary()).to_pylist() for i in (4, 5))
            for x, y in zip(a, b, strict=True):
                if x != last:
                    last, last_set = x, shingles(x)
                other = shingles(y)
                both = len(last_set & other)
                keep.append(100 * both >= share * (len(last_set) + len(other) - both))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return scan


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, uversion, v, vversion, a, b): pairs with their texts; both joins read one exchange of the texts."""
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("text").alias("_text"))
    its = lambda x: (F.col(x) == F.col("_id")) & (F.col(f"{x}version") == F.col("_version"))
    texts = texts.hint("merge")
    with_v = pairs.join(texts, its("v")).select("u", "uversion", "v", "vversion", F.col("_text").alias("b"))
    return with_v.join(texts, its("u")).select("u", "uversion", "v", "vversion", F.col("_text").alias("a"), "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v) of the ``pairs`` (u, uversion, v, vversion) whose texts' shingle sets are similar enough."""
    return _with_texts(pairs, texts).mapInArrow(_confirm(size, similarity), "u long, v long")


def _alike(similarity: float) -> Column:
    """Whether sizes (nu, nv) and signatures (su, sv) leave a pair similar enough."""
    return (estimate(F.col("su"), F.col("sv")) >= similarity - MARGIN) & (
        F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * round(similarity * 100)
    )


def _possible(similarity: float) -> Column:
    """Whether a pair could be similar enough if it had all shingles (mu, mv) in common that others have at all."""
    share = round(similarity * 100)
    return F.least("mu", "mv") * (100 + share) >= (F.col("nu") + F.col("nv")) * share


def _sets(size: int):
    """Texts to rows of their shingles, and one row of its own for each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, version, text in zip(ids, versions, batch.column(2).cast(pa.string()).cast(pa.binary()).to_pylist(), strict=True):
                own = xxhash.xxh3_64_intdigest(f"{doc_id}:{version}".encode())
                found = np.append(shingle_hashes(text.lower().split(), hashes, size), np.uint64(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), doc_id, np.int64)), pa.array(np.full(len(found), version, np.int64)), pa.array(found)],
                    ["doc_id", "version", "shingle"],
                )

    return scan


def _linked(similarity: float) -> Column:
    """Whether a pair is similar enough, from what either set lacks and has beside the hub's (h shingles): exact."""
    both = F.col("hu") - F.size("withoutu") - F.size("withoutv") + F.size(F.array_intersect("withoutu", "withoutv")) + F.size(F.array_intersect("withu", "withv"))
    share = round(similarity * 100)
    return both * 100 >= (F.col("nu") + F.col("nv") - both) * share


def _differences(size: int, similarity: float):
    """Pairs with both texts to (u, uversion, v, vversion, linked, hub_shingles, missing, extra): v's set against u's."""
    share = round(similarity * 100)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, hub = WordHashes(), None, np.empty(0, np.uint64)
        for batch in pieces(batches):
            linked, n, missing, extra = [], [], [], []
            a, b = (batch.column(i).cast(pa.string()).cast(pa.binary()).to_pylist() for i in (4, 5))
            for x, y in zip(a, b, strict=True):
                if x != last:
                    last, hub = x, shingle_hashes(x.lower().split(), hashes, size)
                other = shingle_hashes(y.lower().split(), hashes, size)
                without, more = (np.setdiff1d(p, q, assume_unique=True) for p, q in ((hub, other), (other, hub)))
                both = len(hub) - len(without)
                linked.append(100 * both >= share * (len(hub) + len(other) - both))
                n.append(len(hub)), missing.append(without.view(np.int64)), extra.append(more.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(missing, longs), pa.array(extra, longs)],
                ["u", "uversion", "v", "vversion", "linked", "hub_shingles", "missing", "extra"],
            )

    return scan


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, doc_id, version, component, largest, bucket_size) of the buckets that hold several components."""
    found = connected_components(links)
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = cut(placed.withColumn("component", F.coalesce("component", "doc_id")), "placed")
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    parts = placed.join(several.select("bucket"), "bucket", "left_semi").groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("bucket_size"))
    return placed.join(largest, "bucket")


def _central(members: DataFrame, signed: DataFrame, links: DataFrame, plain: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """More links, and the buckets that are open after them, each member with its differences from the bucket's hub.

    A shingle that one open document alone has is in no intersection, which bounds each similarity from above without
    looking at pairs: what can't reach the bound with anyone is done. In each open bucket the document with the fewest
    such shingles, the most central one, becomes the hub of a second star.
    """
    text_id = ["doc_id", "version"]
    open_ = cut(_open(members.select("bucket", *text_id), links), "open")
    texts = plain.join(open_.select(*text_id).distinct().hint("merge"), text_id, "left_semi")
    sets = texts.select(*text_id, "text").mapInArrow(_sets(size), "doc_id long, version long, shingle long")
    owned = sets.groupBy("shingle").agg(F.count("*").alias("n"), F.min(F.struct(*text_id)).alias("owner")).where("n = 1")
    lone = owned.groupBy("owner").agg((F.count("*") - 1).alias("lone")).select("owner.*", "lone")
    known = signed.join(cut(lone, "lone-shingles"), text_id, "left").withColumn("common", F.col("n_shingles") - F.coalesce("lone", F.lit(0)))
    known = known.where(F.col("common") * 100 >= F.col("n_shingles") * round(similarity * 100)).drop("lone")
    members = open_.select("bucket", *text_id).join(known, text_id)
    central = F.max_by(F.struct(*text_id), F.struct(F.col("common") / F.col("n_shingles"), -F.col("doc_id"), "version"))
    hubs = members.groupBy("bucket").agg(central.alias("h")).select("bucket", F.col("h.doc_id").alias("hub"), F.col("h.version").alias("hub_version"))
    members = cut(members.join(hubs, "bucket"), "open-members")
    pairs = members.select(F.col("hub").alias("u"), F.col("hub_version").alias("uversion"), F.col("doc_id").alias("v"), F.col("version").alias("vversion"))
    pairs = cut(pairs.distinct(), "central-pairs")
    found = cut(_with_texts(pairs, plain).mapInArrow(_differences(size, similarity), _DIFFERENCES), "differences")
    before = links
    links = cut(links.unionByName(found.where("linked AND u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))), "central-links")
    told = found.select(
        F.col("u").alias("hub"), F.col("uversion").alias("hub_version"), F.col("v").alias("doc_id"), F.col("vversion").alias("version"), "hub_shingles", "missing", "extra"
    )
    again = _open(members.select("bucket", *text_id), links).join(members, ["bucket", *text_id]).join(told, ["hub", "hub_version", *text_id])
    again = cut(again, "open-again")
    forget(before, open_, pairs, found, members)
    return links, again


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z in lower case. Documents are linked if the Jaccard similarity of
    their sets of ``shingle_words``-word shingles is ``similarity`` (in whole percent) or more; component_id is the
    smallest doc_id that links lead to, and a document is kept if that is its own. Texts of fewer words are one shingle;
    null texts and texts without words have none and are linked with nothing. Rows without a doc_id are kept, have no
    component_id and link nothing; rows that repeat a doc_id count as one document with the links of all of them. An
    empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("version"), "text")
    rows = cut(plain.mapInArrow(_features(shingle_words), _FEATURES), "minhash")
    named = rows.where("class IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "version", "n_shingles", "signature", "bands")).alias("r"))
    classes = cut(first.select("class", "r.*"), "classes")
    # an id with several classes is linked with whoever stands for each of them
    kind = F.xxhash64("class")
    several = named.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo < hi").select("doc_id")
    own = named.select("doc_id", "class").join(cut(several, "several-texts"), "doc_id", "left_semi").join(classes.select("class", F.col("doc_id").alias("u")), "class")
    own = own.where("u <> doc_id").select("u", F.col("doc_id").alias("v")).distinct()

    spread = classes.select("doc_id", "version", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(spread.join(hubs, "bucket"), "buckets")
    # the only texts that are looked at again, each once; they go through one shuffle of all texts and are few afterwards
    text_id = ["doc_id", "version"]
    shared = plain.where("text IS NOT NULL").join(members.select(*text_id).distinct().hint("merge"), text_id, "left_semi")
    plain = cut(shared.dropDuplicates(text_id), "shared-texts")
    signed = classes.select(*text_id, "n_shingles", "signature")
    u, v = (
        signed.select(
            F.col("doc_id").alias(x), F.col("version").alias(f"{x}version"), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}")
        )
        for x in "uv"
    )
    stars = members.where("doc_id <> hub").select(F.col("hub").alias("u"), F.col("doc_id").alias("v"), F.col("version").alias("vversion")).distinct()
    stars = stars.join(v, ["v", "vversion"]).join(u, "u").where(_alike(similarity)).select("u", "uversion", "v", "vversion")
    links = cut(confirmed(cut(stars, "star-pairs"), plain, shingle_words, similarity).unionByName(own), "star-links")

    # the second look: buckets that still hold several components, less what the rare shingles rule out
    links, open_ = _central(members, signed, links, plain, shingle_words, similarity)
    salts = F.ceil(F.col("bucket_size") / PART)
    salt = {"u": F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)), "v": F.pmod(F.xxhash64(*text_id), salts)}
    x, y = (
        open_.select(
            F.col("bucket").alias(f"k{i}"), F.col("doc_id").alias(i), F.col("version").alias(f"{i}version"), F.col("component").alias(f"c{i}"),
            F.col("largest").alias(f"l{i}"), F.col("n_shingles").alias(f"n{i}"), F.col("signature").alias(f"s{i}"), F.col("common").alias(f"m{i}"),
            F.col("hub_shingles").alias(f"h{i}"), F.col("missing").alias(f"without{i}"), F.col("extra").alias(f"with{i}"), salt[i].alias(f"p{i}"),
        )
        for i in "uv"
    )
    once = (F.col("cv") == F.col("lv")) | (F.col("u") < F.col("v"))
    alike = _possible(similarity) & _alike(similarity) & _linked(similarity)
    across = x.where("cu <> lu").join(y, (F.col("ku") == F.col("kv")) & (F.col("pu") == F.col("pv")) & (F.col("cu") != F.col("cv")) & once & alike)
    between = [F.least("cu", "cv").alias("c"), F.greatest("cu", "cv").alias("d")]
    pair = ["u", "uversion", "v", "vversion"]
    # any one pair will do; columns of plain longs are aggregated in place, without a sort of all pairs
    one = cut(across.groupBy(*between).agg(*[F.first(x).alias(x) for x in pair]), "rest-pairs")
    more = cut(confirmed(one.select(*pair), plain, shingle_words, similarity).distinct(), "rest-links")
    failed = one.join(more, ["u", "v"], "left_anti").select("c", "d")
    if not failed.isEmpty():  # a pair that the sets don't bear out: all links of those components are confirmed
        rest = across.select(*between, *pair).join(failed.distinct(), ["c", "d"], "left_semi").select(*pair).distinct()
        more = cut(more.unionByName(confirmed(rest, plain, shingle_words, similarity)), "rest-links-all")
    final = connected_components(cut(links.unionByName(more), "all-links"))

    named = classes.select("class", F.col("doc_id").alias("first")).join(
        final.select(F.col("node").alias("first"), "component"), "first", "left"
    )
    named = cut(named.select(F.col("class").alias("_class"), F.coalesce("component", "first").alias("component")), "class-components")
    forget(classes, members, plain, links, open_, one, more)
    out = rows.select("doc_id", "n_shingles", "class").join(named, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, Jaccard similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 0.85)
