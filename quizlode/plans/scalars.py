"""Queries of scalars and small rules: formulas, phrases, pictures, slots, audits and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import evidence, export, layout, quiz
from ..sources import adapters, table
from .registry import query


@query("""SELECT p_partkey AS id, p_size % 4 < 3 AS formula, CASE p_size % 4 WHEN 1 THEN 'exponent-may-be-flattened' WHEN 2 THEN 'exponent-digits-merged' ELSE '' END AS damage, '"a b ' || p_name || '"' AS phrase,
 CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'ear bone' END AS core FROM part""")
def formula_signals(spark, folder):
    size, name = F.col("p_size"), F.col("p_name")
    shown = F.element_at(F.array(F.lit("v = s / t"), F.lit("10-9 nm and 5 nm"), F.lit("about 1012 Гц wide, 12 Гц"), name), size % 4 + 1)
    term = F.when(size % 2 == 0, F.concat(name, F.lit(" Muscle"))).otherwise("ear bone")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), text.looks_like_formula(shown).alias("formula"), F.array_join(text.formula_damage(shown), ",").alias("damage"),
        text.quoted_phrase(F.concat(F.lit('a "b" ('), name, F.lit(")"))).alias("phrase"), text.core_term(term).alias("core"),
    )


@query("""WITH p AS (SELECT vec_id, list_transform(embedding[1:64], lambda v: CASE WHEN v > 0 THEN 255.0 ELSE 16.0 END) AS g FROM embeddings), m AS (SELECT vec_id, g, list_avg(g) AS mean FROM p),
h AS (SELECT vec_id, list_transform(range(16), lambda i: substr('0123456789abcdef', (list_sum(list_transform(range(4), lambda k: CASE WHEN g[i * 4 + k + 1] > mean THEN 1 << (3 - k)::INT ELSE 0 END)) + 1)::INT, 1)) AS hex, g FROM m)
SELECT vec_id, array_to_string(hex, '') AS average, array_to_string(list_transform(g, lambda v: CASE WHEN v > 100 THEN 'f' ELSE '1' END), '') AS fine FROM h""")
def picture_hashes(spark, folder):
    gray = F.transform(F.slice("embedding", 1, 64), lambda v: F.when(v > 0, 255.0).otherwise(16.0))
    return table(spark, folder, "embeddings").select("vec_id", text.average_hash(gray).alias("average"), text.fine_fingerprint(gray).alias("fine"))


@query(r"""WITH RECURSIVE c AS (SELECT p_partkey AS id, p_brand AS s, 0 AS i, 2166136261::HUGEINT AS a, 16777619::HUGEINT AS b FROM part UNION ALL
 SELECT id, s, i + 1, (xor(a, ascii(s[i + 1])::HUGEINT) * 16777619) % 4294967296, (xor(b, ascii(s[i + 1])::HUGEINT) * 1540483477) % 4294967296 FROM c WHERE i < length(s)),
f AS (SELECT id, a, b FROM c WHERE i = length(s))
SELECT id, 'mdl-img-' || lower(to_base(a::BIGINT, 36)) || lower(to_base(b::BIGINT, 36)) AS picture_id FROM f""")
def picture_ids(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.picture_id(F.col("p_brand")).alias("picture_id"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE k WHEN 0 THEN CASE WHEN crosses > 0 THEN 'CONFLICT' WHEN checks > 0 THEN 'CONFIRMED_BY_SCORE' ELSE 'UNRESOLVED' END WHEN 1 THEN CASE WHEN checks > 0 THEN 'NEEDS_REVIEW' ELSE 'UNRESOLVED' END
 WHEN 2 THEN CASE WHEN checks = 1 AND crosses > 0 THEN 'CONFIRMED_BY_DOCUMENT' ELSE 'UNRESOLVED' END ELSE CASE WHEN checks > 0 AND crosses = 0 THEN 'CONFIRMED_BY_DOCUMENT' ELSE 'UNRESOLVED' END END AS status
FROM (SELECT *, l_linenumber % 4 AS k, l_suppkey % 3 AS checks, l_partkey % 2 AS crosses FROM lineitem)""")
def scored_answers(spark, folder):
    marks = lambda n: F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), n.cast("int"))
    kind = adapters._one_of(F.col("l_linenumber"), "FULL_SCORE", "PARTIAL_SCORE", "ZERO_SCORE", "NO_SCORE")
    found = evidence.scored_answer(kind, marks(F.col("l_suppkey") % 3), marks(F.col("l_partkey") % 2), F.array().cast("array<int>"), F.lit(0.95))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", found["status"].alias("status"))


@query("""SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS slots, o_orderkey % 4 = 0 AS blanks, o_orderkey % 5 = 0 AS choice FROM orders""")
def quiz_answers(spark, folder):
    key = F.col("o_orderkey")
    want = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    placed = F.when(key % 3 == 0, F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).otherwise(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)))
    typed = F.when(key % 4 == 0, F.array(F.lit("Вены "), F.lit("Нерв"))).otherwise(F.array(F.lit("вены"), F.lit("кость")))
    picked = F.when(key % 5 == 0, F.array(F.lit("C"), F.lit("A"))).otherwise(F.array(F.lit("A")))
    return table(spark, folder, "orders").select(
        key.alias("id"), quiz.slots_right(placed, want).alias("slots"), quiz.blanks_right(typed, F.array(F.lit("вены"), F.lit("нерв"))).alias("blanks"), quiz.choice_right(picked, F.lit("A,C")).alias("choice")
    )


@query("""WITH l AS (SELECT l_orderkey AS d, l_linenumber AS p, l_returnflag <> 'R' AS line, l_linestatus = 'F' AS used FROM lineitem),
c AS (SELECT l_orderkey AS d, count(*) AS expected, count(*) FILTER (WHERE l_quantity > 3) AS found, count(*) FILTER (WHERE l_tax = 0.08) AS failed, count(*) FILTER (WHERE l_discount = 0.1) AS conflicts FROM lineitem GROUP BY 1),
u AS (SELECT DISTINCT d, p FROM l WHERE used), o AS (SELECT d, count(*) AS orphans FROM l WHERE line AND (d, p) NOT IN (SELECT (d, p) FROM u) GROUP BY 1)
SELECT c.d AS document_id, coalesce(orphans, 0) AS orphans, concat_ws(',', CASE WHEN expected > found THEN 'MISSING_QUESTIONS' END, CASE WHEN orphans > 0 THEN 'ORPHAN_LINES' END, CASE WHEN failed > 0 THEN 'FAILED_QUESTIONS' END, CASE WHEN conflicts > 0 THEN 'ANSWER_CONFLICTS' END) AS problems,
 CASE WHEN expected > found OR coalesce(orphans, 0) > 0 OR failed > 0 THEN 'PROCESSING_INCOMPLETE' ELSE 'COMPLETE' END AS status FROM c LEFT JOIN o ON c.d = o.d""")
def document_audit(spark, folder):
    rows = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    lines = rows.select("document_id", F.lit(1).alias("page"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", "NOISE").otherwise("TEXT").alias("role"))
    used = rows.where("l_linestatus = 'F'").select("document_id", F.lit(1).alias("page"), F.col("l_linenumber").alias("pos"))
    lost = layout.orphans(lines, used).groupBy("document_id").agg(F.count("*").alias("orphans"))
    counts = rows.groupBy("document_id").agg(
        F.count("*").alias("expected"), F.count_if(F.col("l_quantity") > 3).alias("found"), F.count_if(F.col("l_tax") == 0.08).alias("failed"), F.count_if(F.col("l_discount") == 0.1).alias("conflicts")
    )
    found = layout.audit(counts.join(lost, "document_id", "left").na.fill(0, ["orphans"]))
    return found.select("document_id", "orphans", F.array_join("problems", ",").alias("problems"), "status")


@query("""SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS place, unnest(['Heading2', 'Normal', 'Normal', 'Strong']) AS style,
 unnest([p_partkey || '. ' || p_name, 'A. ' || p_brand, 'B. ' || p_type, CASE WHEN p_size % 3 = 0 THEN 'Answer: Not detected (Needs Review)' ELSE 'Answer: ' || ['A', 'B', 'Z'][(p_size % 3 + 1)::INT] END]) AS text FROM part""")
def word_paragraphs(spark, folder):
    return export.word_paragraphs(adapters.flat_rows(spark, folder))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '{first}' ELSE '' END AS hints FROM part".format(first=next(iter(rules.SUBJECT_TERMS))))
def subject_hints(spark, folder):
    subject, terms = next(iter(rules.SUBJECT_TERMS.items()))
    stem = F.when(F.col("p_size") % 2 == 0, F.lit(f"{terms[0]} и {terms[1]}")).otherwise(F.lit("zz"))
    return layout.subject_hints(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), stem.alias("text"))).select("id", F.array_join("hints", ",").alias("hints"))
