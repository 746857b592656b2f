"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text. A string that looks like a credential may be one, or an example that everybody
copies: so the hashes of all candidates are counted over the corpus, by distinct owners and by distinct repositories.
What many owners hold, or two of them in many repositories, is an example; what one owner holds looks live, and so does
what two share in few repositories. The fixed patterns of the contract stand in either case; candidates of the other
patterns are reported where they look live.

Offsets come from the pieces between the matches: a pattern's matches and the text split at them alternate, so running
lengths of both give every start. Only the texts with matches, and of them only lengths and hashes, are shuffled for
that. Every pattern takes time in proportion to the text: whatever stands before a fixed part is bounded in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, forget, table

#: The fixed patterns of the contract, by kind: pattern, the group that is the secret, and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
#: Public formats of other credentials, found beside the fixed ones.
MORE = (
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,400}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", 0, 60),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("url", r"[a-z][a-z0-9+.-]{0,15}://[^\s/:@]+:[^\s/:@]{6,}@", 0, 14),
)
#: From so many distinct owners on a candidate is a copied example, or from two owners and so many repositories on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5

_KINDS = [kind for kind, *_ in BASE + MORE]
_MATCHES = "array<struct<kind:int,i:int,gap:int,length:int,hash:string>>"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,hash:string>>"


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """(kind, i, gap, length, hash) of the pattern's matches, leftmost first and apart: what stands before each, its own
    length, and the hash of its secret, null if that is too short."""
    lit = F.lit(pattern)
    whole, secret = F.regexp_extract_all(text, lit, F.lit(0)), F.regexp_extract_all(text, lit, F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("m"), secret.alias("s")),
        lambda x, i: F.struct(
            F.lit(_KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("length"),
            F.when(F.length(x["s"]) >= least, F.sha2(x["s"], 256)).alias("hash"),
        ),
    )
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), rows).otherwise(F.array().cast(_MATCHES))


def _spans(rows: DataFrame) -> DataFrame:
    """(doc_id, version, start, kind, end, hash) of the matches of ``rows``, each text once."""
    once = rows.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", F.inline("matches"))
    text = W.partitionBy("doc_id", "version", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("length")).cast("long")).over(text)
    spans = once.withColumn("end", end).where("hash IS NOT NULL")
    return spans.select("doc_id", "version", (F.col("end") - F.col("length")).alias("start"), "kind", "end", "hash")


def _written(spans: Column) -> Column:
    """kind:start:end, by start and then kind."""
    names = F.array(*[F.lit(k) for k in _KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of candidates (hash, owner, repository); nulls are an owner of their own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c)
    once = candidates.select("hash", name("owner"), name("repository")).distinct()
    owners = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def is_example(c: Column, owners: int = EXAMPLE_OWNERS, repositories: int = EXAMPLE_REPOSITORIES) -> Column:
    """Whether a candidate is widely copied."""
    return (c["n_owners"] >= owners) | ((c["n_owners"] > 1) & (c["n_repositories"] >= repositories))


def scan_secrets(
    docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): base and all spans, with what the corpus says about each.

    Returns doc_id, base and spans, arrays of (start, kind, end, hash), kind being a number of the list of kinds, offsets
    in code points and ends exclusive; and candidates, the same with n_owners and n_repositories. A repository is counted
    once for each of its owners. spans are the base spans and those candidates of other kinds that are no examples. A null
    or empty text has none; rows that repeat a doc_id are judged by their own texts, and each of them names its owner; an
    empty table gives no rows; other columns of ``docs`` serve the ``owner`` and ``repository`` expressions only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    matches = F.concat(*[_matches(text, *x) for x in BASE + MORE])
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), matches.alias("matches"))
    rows = cut(rows, "secrets")
    some = rows.where(F.size("matches") > 0)
    spans = cut(_spans(some), "secret-spans")
    owners = some.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "owner", "repository").distinct()
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    counted = spans.join(ownership(spans.join(owners, own).select("hash", "owner", "repository")), "hash")
    told = counted.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repositories"))).alias("candidates")
    )
    told = cut(told.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "candidates"), "secret-candidates")
    forget(spans)
    out = rows.drop("matches", "owner", "repository").join(told, own, "left")
    live = lambda c: (c["kind"] < len(BASE)) | ~is_example(c, example_owners, example_repositories)
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["hash"].alias("hash"))
    chosen = lambda which: F.coalesce(F.transform(F.filter("candidates", which), plain), F.array().cast(_SPANS))
    return out.select("doc_id", chosen(lambda c: c["kind"] < len(BASE)).alias("base"), chosen(live).alias("spans"), "candidates")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a source is an owner, and its documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == _KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind, *_ in BASE],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        F.coalesce(F.size(F.filter("candidates", lambda c: is_example(c))), F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce(F.size(F.filter("candidates", lambda c: ~is_example(c))), F.lit(0)).cast("long").alias("n_live"),
    )


def _sql() -> str:
    parts = []
    for k, (kind, pattern, group, least) in enumerate(BASE + MORE):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS s, "
            f"string_split_regex(text, '{p}') AS g, {least} AS least FROM d WHERE regexp_matches(text, '{p}')"
        )
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT r, k, kind, m, s, g, least, unnest(range(1, len(m) + 1)) AS i FROM m),
c AS (SELECT r, k, kind, s[i] AS secret,
             (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n
      FROM i WHERE length(s[i]) >= least),
o AS (SELECT secret, count(DISTINCT d.owner) AS owners, count(DISTINCT (d.owner, d.repository)) AS repositories FROM c JOIN d USING (r) GROUP BY secret),
x AS (SELECT c.*, kind || ':' || a || ':' || (a + n) AS t, owners >= {EXAMPLE_OWNERS} OR (owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES}) AS example FROM c JOIN o USING (secret)),
z AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(t, ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}) AS base,
             string_agg(t, ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)} OR NOT example) AS spans,
             count(*) FILTER (WHERE example) AS n_examples, count(*) FILTER (WHERE NOT example) AS n_live
      FROM x GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_examples, 0)::BIGINT AS n_examples, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN z USING (r)
"""


SQL = _sql()
