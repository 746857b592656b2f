"""Line dedup by a tree of log templates.

Lines are parsed as a log parser does: tokens with digits become a wildcard, and a tree of fixed depth sorts lines by
their number of tokens and then by their leading tokens. What follows the leading tokens is divided into fields, and a
leaf's templates are its lines with up to two fields generalised, together at most a fifth of the tokens. So a leaf has
as many templates as it has families of lines, and lines that differ more are templates of their own. Of the templates
that fit a line and occur in many documents, the line belongs to the one with most lines. Such a template is
boilerplate: all its lines are dropped but the first of the corpus, so that no content is lost altogether. Documents
with the same text count once, so mere copies of a document do not turn its lines into boilerplate.

All counting is by 60-bit hashes with partial sums over distinct lines, never over pairs of lines; a template's hash is
the sum of its fields' hashes less the generalised ones. The text of lines is moved only for leaves that are widespread
and hold more than one line. Built-in functions alone, in every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, table

#: Leading tokens of the tree, the percentage of tokens that a template fixes at least, and the documents (distinct
#: texts) from which a template counts as recurring.
DEPTH, FIXED, LEAST_DOCS = 3, 80, 10

_BLANKS = r"[\x20\x09-\x0D]+"
_VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _number(text: Column) -> Column:
    """60 bits of an MD5; never null, so that joins on it add no test of their own."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, version, pos, clean, leaf) of all lines with tokens."""
    # a text is hashed before it is divided, once and not for every line
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    rows = rows.select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _VARIABLE, "<*>")).otherwise(F.col("line"))
    # most lines have single blanks already
    clean = F.trim(F.when(F.col("line").rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(masked, _BLANKS, " ")).otherwise(masked))
    rows = rows.select("doc_id", "version", "pos", clean.alias("clean"))
    lead = F.substring_index("clean", " ", depth)
    n = F.length("clean") - F.length(F.replace("clean", F.lit(" "), F.lit(""))) + 1
    return rows.select("doc_id", "version", "pos", "clean", _number(F.concat(n.cast("string"), F.lit(" "), lead)).alias("leaf"))


def _templates(lines: DataFrame, depth: int, fixed: int) -> DataFrame:
    """(leaf, line, n, i, j, key) for distinct lines (leaf, line, n, clean): each with its fields i and j generalised.

    The tokens after the first ``depth`` are fields of half of the tokens that may vary, at least one each. Lines of
    which no token may vary have no row here, those of which one may have a row for each token.
    """
    tokens = F.split("clean", " ")
    rows = lines.select("leaf", "line", "n", F.slice(tokens, depth + 1, 1 << 30).alias("rest"), F.floor(F.size(tokens) * (100 - fixed) / 100).cast("int").alias("free"))
    rows = rows.where("free > 0 AND size(rest) > 0").withColumn("width", F.greatest(F.lit(1), F.floor(F.col("free") / 2).cast("int")))
    n = F.ceil(F.size("rest") / F.col("width")).cast("int")
    field = lambda i: F.xxhash64(i, F.array_join(F.slice("rest", i * F.col("width") + 1, F.col("width")), " "))
    rows = rows.withColumn("fields", F.transform(F.sequence(F.lit(0), n - 1), field))
    rows = rows.withColumn("all", F.aggregate("fields", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    one = (F.col("free") == 1) | (F.size("fields") == 1)
    rows = rows.select("leaf", "line", "n", "fields", "all", one.alias("one"), F.posexplode("fields").alias("i", "own"))
    other = F.when(F.col("one"), F.array("i")).when(F.col("i") + 1 < F.size("fields"), F.sequence(F.col("i") + 1, F.size("fields") - 1))
    rows = rows.select("leaf", "line", "n", "fields", "all", "one", "i", "own", F.explode(other).alias("j"))
    rest = F.when(F.col("one"), F.lit(0).cast("long")).otherwise(F.get("fields", F.col("j")))
    return rows.select("leaf", "line", "n", "i", "j", F.col("all").bitwiseXOR(F.col("own")).bitwiseXOR(rest).alias("key"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, fixed: int = FIXED, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, version, positions): the lines of each text that are dropped, by position; version is a hash of the text."""
    lines = _lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), depth)
    narrow = cut(lines.select("doc_id", "version", "pos", "leaf", _number(F.col("clean")).alias("line")), "lines")
    by_line = narrow.select("leaf", "line", "version").distinct().groupBy("leaf", "line").agg(F.count("*").alias("n"))
    by_line = cut(by_line, "distinct-lines")
    leaves = by_line.groupBy("leaf").agg(F.sum("n").alias("most"), F.count("*").alias("lines")).where(F.col("most") >= least_docs)
    leaves = cut(leaves.select("leaf", "lines"), "leaves")

    # lines of several in their leaf, once each, and the templates that fit them
    several = lines.join(leaves.where("lines > 1").select("leaf"), "leaf").select("leaf", _number(F.col("clean")).alias("line"), "clean")
    several = several.groupBy("leaf", "line").agg(F.first("clean").alias("clean")).join(by_line, ["leaf", "line"])
    fits = cut(_templates(several, depth, fixed), "line-templates")
    template = ["leaf", "i", "j", "key"]
    wide = fits.groupBy(*template).agg(F.sum("n").alias("weight"), F.max("n").alias("most"), F.count("*").alias("members")).where((F.col("weight") >= least_docs) & (F.col("members") > 1))
    wide = cut(wide.drop("members"), "wide-templates")
    # only templates without any widespread line need their texts counted: lines of few texts each
    unsure = fits.join(wide.where(F.col("most") < least_docs).select(*template), template).select("line", *template)
    texts = unsure.join(narrow.select("leaf", "line", "version"), ["leaf", "line"]).select(*template, "version").distinct()
    enough = texts.groupBy(*template).agg(F.count("*").alias("texts")).where(F.col("texts") >= least_docs).select(*template)
    sure = wide.where(F.col("most") >= least_docs).select(*template).unionByName(enough).join(wide.drop("most"), template)
    general = fits.join(sure, template).select("leaf", "line", "i", "j", "key", "weight")
    alone = by_line.where(F.col("n") >= least_docs).select(
        "leaf", "line", F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("line").alias("key"), F.col("n").alias("weight")
    )
    own = general.unionByName(alone).groupBy("leaf", "line").agg(F.max_by(F.struct("i", "j", "key"), F.struct("weight", -F.col("i"), -F.col("j"))).alias("t"))
    own = cut(own.select("leaf", "line", "t.*"), "recurring-lines")

    placed = cut(narrow.join(own, ["leaf", "line"]).drop("line"), "places")
    forget(narrow, by_line, leaves, fits, wide)
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("pos"))
    first = placed.groupBy(*template).agg(F.min(at).alias("first"))
    gone = placed.join(first, template).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("positions"))


def _without(lines: Column, positions: Column) -> Column:
    """Lines but those at ``positions``: both are sorted by position, so that a dropped line has its mark next to it."""
    of_line = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.lit(0).alias("mark"), line.alias("line")))
    of_mark = F.transform(positions, lambda p: F.struct(p.alias("pos"), F.lit(1).alias("mark"), F.lit("").alias("line")))
    row = F.sort_array(F.concat(of_line, of_mark))
    pairs = F.zip_with(row, F.slice(row, 2, 1 << 30), lambda x, y: F.struct(x["line"].alias("line"), ((x["mark"] == 0) & ~(F.coalesce(y["mark"], F.lit(0)) == 1)).alias("stays")))
    return F.transform(F.filter(pairs, lambda x: x["stays"] & x["line"].isNotNull()), lambda x: x["line"])


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, fixed: int = FIXED, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of ``docs`` as column ``row``, with ``n_lines``, ``n_dropped`` and the ``text`` that is left.

    docs has doc_id and text. Lines end at \\n; a line's tokens are its runs without ASCII white space. A template that
    occurs in ``least_docs`` distinct texts or more is dropped wherever it stands, save its first place by doc_id and
    position. Lines without tokens stay. A null text stays null and has no lines; an empty one has one line, without
    tokens. Rows without a doc_id count as one document that comes after all others; rows that repeat a doc_id and text
    lose the same lines, and lines of an id at one position are one place. A document that loses every line keeps its row, with an empty text. An empty
    table gives no rows; other columns are carried along.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_version")
    )
    gone = cut(recurring_lines(docs, depth, fixed, least_docs), "dropped-lines").hint("merge")
    out = rows.join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_version") == F.col("version")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n", -1)
    left = F.array_join(_without(lines, F.col("positions")), "\n")
    return out.select(
        "row",
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("positions").isNotNull(), left).otherwise(F.col("row.text").cast("string")).alias("text"),
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with its lines, the lines dropped and a hash of the text that is left."""
    found = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, md5(text) AS version, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT r, doc_id, version, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d),
v AS (SELECT r, doc_id, version, pos, trim(regexp_replace(regexp_replace(ls[pos], '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS clean FROM u),
l AS MATERIALIZED (SELECT * FROM v WHERE clean <> ''),
b AS MATERIALIZED (SELECT clean, string_split(clean, ' ') AS t, count(DISTINCT version) AS n FROM l GROUP BY clean),
f AS (SELECT clean, t, n, len(t) * {100 - FIXED} // 100 AS free, greatest(1, len(t) * {100 - FIXED} // 100 // 2) AS w FROM b),
g AS (SELECT *, CASE WHEN free = 0 OR len(t) <= {DEPTH} THEN 0 ELSE (len(t) - {DEPTH} + w - 1) // w END AS s FROM f),
i AS (SELECT *, unnest(range(0, s)) AS i FROM g),
j AS (SELECT *, unnest(CASE WHEN free = 1 OR s = 1 THEN [i] ELSE range(i + 1, s) END) AS j FROM i),
m AS (SELECT clean, n, i, j, array_to_string(list_transform(range(1, len(t) + 1), lambda p: CASE WHEN p > {DEPTH} AND ((p - {DEPTH} - 1) // w = i OR (p - {DEPTH} - 1) // w = j) THEN '' ELSE t[p] END), ' ') AS template FROM j
      UNION ALL SELECT clean, n, -1, -1, clean FROM g),
k AS MATERIALIZED (SELECT i, j, template, sum(n) AS weight FROM m GROUP BY ALL HAVING sum(n) >= {LEAST_DOCS}),
x AS MATERIALIZED (SELECT m.clean, k.* FROM m JOIN k USING (i, j, template)),
e AS (SELECT i, j, template FROM x JOIN l USING (clean) GROUP BY ALL HAVING count(DISTINCT version) >= {LEAST_DOCS}),
o AS (SELECT clean, arg_max((i, j, template), (weight, -i, -j)) AS own FROM x JOIN e USING (i, j, template) GROUP BY clean),
p AS (SELECT r, doc_id, pos, own FROM l JOIN o USING (clean)),
q AS (SELECT own, min((doc_id IS NULL, doc_id, pos)) AS first FROM p GROUP BY own),
z AS (SELECT r, list(pos) AS gone FROM p JOIN q USING (own) WHERE (doc_id IS NULL, doc_id, pos) <> first GROUP BY r)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text
                            ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""
