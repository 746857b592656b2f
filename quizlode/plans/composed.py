"""Queries of answers, groups and repairs: from evidence of single questions to the rows of a bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleanup, similarity, text
from ..operators import compose, evidence, quiz, repair, resolve
from ..sources import adapters, spread, table, work_folder
from .registry import query

_KINDS = "['FULL_SCORE', 'PARTIAL_SCORE', 'ZERO_SCORE', 'NO_SCORE'][(p_size % 4 + 1)::INT]"


def _kind():
    return adapters._one_of(F.col("p_size"), "FULL_SCORE", "PARTIAL_SCORE", "ZERO_SCORE", "NO_SCORE")


@query(f"""WITH q AS (SELECT p_partkey AS id, p_size % 3 AS n, CASE WHEN p_size % 5 = 0 THEN p_name END AS inline, CASE WHEN p_size % 7 > 0 THEN p_brand END AS response, {_KINDS} AS kind FROM part),
w AS (SELECT *, CASE WHEN n > 0 THEN 0 WHEN inline IS NOT NULL THEN 1 WHEN response IS NOT NULL AND kind = 'FULL_SCORE' THEN 2 WHEN response IS NOT NULL AND kind = 'PARTIAL_SCORE' THEN 3 ELSE 0 END AS c FROM q)
SELECT id, CASE c WHEN 1 THEN inline WHEN 2 THEN response WHEN 3 THEN response END AS text_answer, ['UNRESOLVED', 'CONFIRMED_BY_DOCUMENT', 'CONFIRMED_BY_SCORE', 'NEEDS_REVIEW'][c + 1] AS status,
 [0.0, 0.88, 0.92, 0.5][c + 1]::DOUBLE AS confidence, c IN (1, 2) AS complete FROM w""")
def typed_answers(spark, folder):
    size = F.col("p_size")
    answer = evidence.typed_answer(size % 3, F.when(size % 5 == 0, F.concat(F.lit(" "), F.col("p_name"))), F.when(size % 7 > 0, F.col("p_brand")).otherwise(" "), _kind())
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), answer.alias("a")).select("id", "a.*")


@query(f"""WITH q AS (SELECT p_partkey AS id, p_name, p_brand, p_size % 3 AS n, p_size % 5 = 0 AS gap, {_KINDS} = 'FULL_SCORE' AS f FROM part), w AS (SELECT *, n >= 2 AND NOT gap AS ok FROM q)
SELECT id, CASE WHEN ok THEN 'x=' || p_name || ';y=' || p_brand END AS pairs, CASE WHEN ok THEN CASE WHEN f THEN 'CONFIRMED_BY_SCORE' ELSE 'NEEDS_REVIEW' END END AS status, CASE WHEN ok THEN CASE WHEN f THEN 0.9 ELSE 0.5 END END::DOUBLE AS confidence FROM w""")
def matching_answers(spark, folder):
    size = F.col("p_size")
    pair = lambda t, p: F.struct(F.lit(t).alias("text"), p.alias("pair"))
    pairs = F.slice(F.array(pair("x", F.when(size % 5 > 0, F.col("p_name"))), pair("y", F.col("p_brand"))), F.lit(1), (size % 3).cast("int"))
    found = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), evidence.matching_answer(pairs, _kind()).alias("a"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("a.matching")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("id", shown.alias("pairs"), "a.status", "a.confidence")


@query("""WITH q AS (SELECT p_partkey AS id, p_size % 4 AS n, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS stem, p_size % 6 = 0 AS blocked, p_size / 50::DOUBLE AS c, p_size % 5 = 0 AS open, (p_size % 10) / 10::DOUBLE AS a FROM part)
SELECT id, CASE WHEN stem = '' AND n = 0 THEN 'FAILED' WHEN blocked OR c < 0.6 THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS extraction_status,
 round(least(c, 0.5::DOUBLE + 0.5::DOUBLE * greatest(a, CASE WHEN open THEN 0.6::DOUBLE ELSE 0 END)), 2) AS confidence FROM q""")
def extraction_status(spark, folder):
    size = F.col("p_size")
    issues = F.when(size % 6 == 0, F.array(F.lit("ODD_SPACING"), F.lit("EMPTY_OPTION"))).when(size % 2 == 0, F.array(F.lit("ODD_SPACING")))
    stem = F.when(size % 9 == 0, "").otherwise(F.col("p_name"))
    answer = F.when(size % 5 == 0, "UNRESOLVED").otherwise("CONFIRMED_BY_SCORE")
    found = evidence.extraction(stem, size % 4, issues, size / 50, F.lit("SINGLE_CHOICE"), answer, (size % 10) / 10)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), found.alias("e")).select("id", "e.*")


_VOTES = """v AS (SELECT l_partkey AS id, (l_suppkey % 4)::INT AS option, l_returnflag = 'R' AS wrong, l_returnflag = 'N' AS picked FROM lineitem),
o AS (SELECT id, option, count(*) FILTER (WHERE wrong) AS wrong, bool_or(picked) AS picked FROM v GROUP BY 1, 2),
h AS (SELECT id, string_agg(option::VARCHAR, ',' ORDER BY option) FILTER (WHERE picked AND wrong = 0) AS keys FROM o GROUP BY 1)"""


@query(f"WITH {_VOTES} SELECT id AS canonical_id, CASE WHEN keys IS NULL THEN 'UNRESOLVED' ELSE 'NEEDS_REVIEW' END AS answer_status, CASE WHEN keys IS NULL THEN 0.0 ELSE 0.4 END::DOUBLE AS confidence, coalesce(keys, '') AS correct_keys FROM h")
def provisional_picks(spark, folder):
    """Multiple choices without a full score: partial scores alone give their answers."""
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("canonical_id"), (F.col("l_suppkey") % 4).cast("int").alias("option"), F.col("l_returnflag").alias("flag"))
    votes = rows.groupBy("canonical_id", "option").agg(F.lit(0).cast("long").alias("correct"), F.count_if(F.col("flag") == "R").alias("incorrect"), F.bool_or(F.col("flag") == "N").alias("picked"))
    options = votes.groupBy("canonical_id").agg(F.collect_list(F.struct("option", "correct", "incorrect", "picked")).alias("options"))
    return resolve.resolve(options.select("canonical_id", "options", F.lit(2).alias("n_members"), F.lit(0).alias("n_complete"), F.lit(0).alias("n_sets"), F.lit(False).alias("by_document"), F.lit(0.0).alias("best"), F.lit(True).alias("multi")))


@query("""WITH m AS (SELECT o_custkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS t, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus || ',x' END AS r, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS p,
 CASE WHEN o_orderkey % 2 = 0 THEN 'CONFIRMED_BY_SCORE' ELSE 'NEEDS_REVIEW' END AS s, (o_orderkey % 7) / 10::DOUBLE AS c FROM orders), b AS (SELECT DISTINCT id FROM m)
SELECT b.id AS canonical_id, (SELECT arg_min(t, k) FROM m WHERE m.id = b.id AND t IS NOT NULL) AS text_answer, (SELECT arg_min(r, k) FROM m WHERE m.id = b.id AND r IS NOT NULL) AS ordered, (SELECT arg_min(p, k) FROM m WHERE m.id = b.id AND p IS NOT NULL) AS pair,
 CASE WHEN b.id % 4 = 0 THEN 'CONFLICT' ELSE coalesce((SELECT arg_min(s, k) FROM m WHERE m.id = b.id AND (t IS NOT NULL OR r IS NOT NULL OR p IS NOT NULL)), 'UNRESOLVED') END AS answer_status,
 CASE WHEN b.id % 4 = 0 THEN 0.3::DOUBLE ELSE coalesce((SELECT round(arg_min(c, k), 2) FROM m WHERE m.id = b.id AND (t IS NOT NULL OR r IS NOT NULL OR p IS NOT NULL)), 0) END AS confidence FROM b""")
def carried_over_answers(spark, folder):
    key = F.col("o_orderkey")
    members = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("canonical_id"), F.lit("d").alias("document_id"), key.alias("sequence"), F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("text_answer"),
        F.when(key % 4 == 0, F.array("o_orderstatus", F.lit("x"))).alias("right_order"), F.when(key % 5 == 0, F.create_map(F.lit("k"), F.col("o_orderstatus"))).alias("matching"),
        F.when(key % 2 == 0, "CONFIRMED_BY_SCORE").otherwise("NEEDS_REVIEW").alias("status"), ((key % 7) / 10).alias("confidence"),
    )
    conflict = F.col("canonical_id") % 4 == 0
    resolved = members.select("canonical_id").distinct().select("canonical_id", F.when(conflict, "CONFLICT").otherwise("UNRESOLVED").alias("answer_status"), F.when(conflict, 0.3).otherwise(0.0).alias("confidence"))
    out = resolve.carried_over(resolved, members)
    return out.select("canonical_id", "text_answer", F.array_join("right_order", ",").alias("ordered"), F.col("matching")["k"].alias("pair"), "answer_status", "confidence")


@query("""SELECT n_regionkey::VARCHAR AS document_id, 'Region of ' || translate(substr(md5(n_name), 1, 16), '0123456789', 'ghijklmnop') || '?' AS question, substr('ABCDE', n_regionkey + 1, 1) AS answer, r_name AS answer_text, 5 AS n_options, 'high' AS confidence, 'answered' AS status, 1::BIGINT AS attempts
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def pages_to_bank(spark, folder):
    # names that differ in a digit would be read as one question
    name = lambda x: F.regexp_extract(x, "Region of (.*)[?]", 1)
    renamed = lambda i: F.when(name(i["str"]) != "", F.replace(i["str"], name(i["str"]), F.translate(F.substring(F.md5(name(i["str"])), 1, 16), "0123456789", "ghijklmnop"))).otherwise(i["str"])
    pages = adapters.positioned_pages(spark, folder).withColumn("items", F.transform("items", lambda i: i.withField("str", renamed(i))))
    found = compose.extract(pages, work_folder(spark, "bank"))
    return found.select("document_id", "question", "answer", "answer_text", F.size("options").alias("n_options"), "confidence", "status", "attempts")


@query("""WITH q AS (SELECT o_orderkey AS id, ['alpha', 'beta', 'gamma', 'delta'][(o_orderkey % 4 + 1)::INT] || ' of ' || o_custkey || ' is found' AS s, o_orderkey % 6 AS k FROM orders)
SELECT id FROM q WHERE k = 1 AND id IN (SELECT b.id FROM q b JOIN q a ON a.s = b.s AND a.k = 0)""")
def filled_copies(spark, folder):
    key = F.col("o_orderkey")
    stem = [adapters._one_of(key, "Alpha", "Beta", "Gamma", "Delta"), F.lit(" of "), F.col("o_custkey").cast("string")]
    question = F.when(key % 6 == 0, F.concat(*stem, F.lit(" ___ is found."))).when(key % 6 == 1, F.concat(*stem, F.lit(" surely often is found"))).otherwise(F.concat(F.lit("x "), key.cast("string")))
    rows = table(spark, folder, "orders").select(key.alias("id"), question.alias("question"), F.create_map().cast("map<string,string>").alias("options"), F.when(key % 6 == 1, "missing_answer").otherwise("answered").alias("status"))
    return compose.filled_copies(rows)


@query("""SELECT p_partkey AS id, 'Which ' || p_name || '?' AS stem, 'a:' || p_brand || ' first|b:Second ' || p_type || '|c:Third|d:' || p_type AS options FROM part""")
def repaired_labels(spark, folder):
    option = lambda label, *parts: F.struct(F.lit(label).alias("label"), F.concat(*parts).alias("text"))
    rows = spread(table(spark, folder, "part"), "p_partkey").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Which "), F.col("p_name"), F.lit("? v a. "), F.col("p_brand"), F.lit(" first 16:24 2 ull 36 ($) = eee")).alias("stem"),
        F.array(option("d", F.col("p_type"), F.lit(" |")), option("b", F.lit("Second "), F.col("p_type"), F.lit(" е c. Third «"))).alias("options"),
    )
    out = repair.repair(rows)
    return out.select("id", "stem", F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["label"], o["text"])), "|").alias("options"))


@query("""SELECT o_custkey AS document_id, o_orderkey * 3 + 2 AS id, CASE WHEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 = 0 THEN 3 ELSE 2 END AS n FROM orders""")
def repaired_sequence(spark, folder):
    """Each order is a cut-off stem, a cut-off copy and a whole question, which repeats an option of
    the ones before: it goes where one of the two kept before still has it."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    whole = F.concat(F.lit("one two three "), F.substring("h", 1, 24), F.lit(" "), F.substring("h", 30, 24))
    own = [F.concat(F.lit("option of this "), F.substring("h", i, 20)) for i in (1, 22)]
    option = lambda x: F.struct(F.lit(None).cast("string").alias("label"), x.alias("text"))
    shared = F.concat(F.lit("shared option of "), F.col("document_id").cast("string"))
    options = F.when(F.col("k") == 2, F.array(option(own[0]), option(own[1]), option(shared))).when(F.col("k") == 1, F.array(option(F.substring(own[0], 1, 20)))).otherwise(F.array().cast("array<struct<label:string,text:string>>"))
    stem = F.when(F.col("k") == 0, F.concat(F.lit("one two three "), F.substring("h", 1, 24))).otherwise(whole)
    asked = rows.select("document_id", (F.col("o_orderkey") * 3 + F.col("k")).alias("id"), (F.col("o_orderkey") * 3 + F.col("k")).alias("sequence"), stem.alias("stem"), options.alias("options"))
    return repair.repair_sequence(asked).select("document_id", "id", F.size("options").alias("n"))


@query(r"""SELECT p_partkey AS id, 'Вода ' || p_name || ', C5-Th2 вазоконстр' AS display, trim(lower(p_name) || ' еж ' || regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS review_key, 'জাতিসংঘের সদর দপ্তর ' || p_size AS mended,
 'висцеральная ткань и ' || p_name AS rejoined, p_name || ' венозная' AS answer, 'Stem ' || p_name AS stem, 'На границе ' || p_size AS option, 'a «' || p_name || '» b ' || CASE WHEN p_size % 2 = 0 THEN '«' || p_brand || '»' ELSE '___' END AS filled,
 upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' x' AS caption, p_name AS quoted, p_name || ' опухоль' AS screen FROM part""")
def cleanup_scalars(spark, folder):
    name, size = F.col("p_name"), F.col("p_size")
    values = F.array(name, F.when(size % 2 == 0, F.col("p_brand")))
    return spread(table(spark, folder, "part"), "p_partkey").select(
        F.col("p_partkey").alias("id"),
        cleanup.display_text(F.concat(F.lit("Во­да "), name, F.lit("  ,  С5-Th2 в а з о к о н с т р "))).alias("display"),
        cleanup.review_key(F.concat(F.upper(name), F.lit(" ⟪Ёж⟫ — "), F.col("p_brand"))).alias("review_key"),
        cleanup.mended_words(F.concat(F.lit("জারসংঘের সদি  দপ্তি "), size.cast("string"))).alias("mended"),
        cleanup.rejoined(F.concat(F.lit("ви с ц ера льн а я ткань и "), name)).alias("rejoined"),
        cleanup.clean_answer(F.concat(name, F.lit(" венознаяБаллов: 0,00 из 1,00"))).alias("answer"),
        cleanup.clean_stem(F.concat(F.lit("Stem "), name, F.lit(" Ответ:"))).alias("stem"),
        cleanup.clean_option(F.concat(F.lit("e.На границе "), size.cast("string"))).alias("option"),
        cleanup.filled(F.lit("a ___ b ___"), values).alias("filled"),
        cleanup.caption(F.concat(F.lit(" — "), name, F.lit("  x.;"))).alias("caption"),
        cleanup.without_quotes(F.concat(F.lit(" «"), name, F.lit("». "))).alias("quoted"),
        repair.screen_text(F.concat(name, F.lit(" опухоль & site.example.org CJ] 16:24 2 ull 36 ($) = eee"))).alias("screen"),
    )


@query(r"""SELECT p_partkey AS id, lower(p_name) || ' вода' AS match_key, lower(p_brand) AS answer_key, lower(p_name) || ' a b' AS tokens, '_____ ' || p_name AS blanks, true AS garbage, p_size % 2 = 0 AS heading, 2.0::DOUBLE AS fine, 0.5::DOUBLE AS coverage, 12.5::DOUBLE AS number, p_name AS plain FROM part""")
def matching_scalars(spark, folder):
    name = F.col("p_name")
    heading = F.when(F.col("p_size") % 2 == 0, "Топографическая анатомия").otherwise("Что такое флегмона?")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), text.match_key(F.concat(F.upper(name), F.lit(" — вoда"))).alias("match_key"), text.answer_key_text(F.concat(F.lit("«"), F.col("p_brand"), F.lit("».  "))).alias("answer_key"),
        F.array_join(text.words(F.concat(name, F.lit(", (A) b!"))), " ").alias("tokens"), text.blanks(F.concat(F.lit("□ "), name)).alias("blanks"),
        cleanup.is_ocr_garbage(F.concat(name, F.lit(" Wвd [[ ]] =~ фqы"))).alias("garbage"), cleanup.is_heading(heading).alias("heading"),
        similarity.fine_distance(F.lit("0246"), F.lit("2424")).alias("fine"), similarity.coverage(F.split(F.lit("a,b"), ","), F.array(F.lit("b"))).alias("coverage"),
        quiz.as_number(F.lit("12,5")).alias("number"), text.strip_markup(F.concat(F.lit("<b>"), name, F.lit("</b>"))).alias("plain"),
    )
