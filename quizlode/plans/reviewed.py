"""Queries of attempt reviews, places on pages, replies and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures, geometry, lookup, records, review
from ..sources import adapters, dealt, table
from .registry import query


def _review_pages(spark, folder):
    """A page for each order: a header, a prompt, and on two of three a score, in two columns; and a second line."""
    key = F.col("o_orderkey")
    item = lambda text, x, y: F.struct(text.alias("str"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"))
    score = F.when(key % 3 > 0, "Баллов: 1,00").otherwise("Отметить")
    items = F.array(item(F.lit("Вопрос"), 20, 10), item(score, 20, 24), item(F.lit("ответ"), 170, 12.5), item(F.lit("Выберите один"), 120, 11), item(F.col("o_orderpriority"), 120, 40), item(F.lit(" "), 20, 60))
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), key.alias("page"), items.alias("items"))


@query("SELECT o_custkey AS document_id, count(*) AS headers, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS scores, count(*) >= 3 AND count(*) FILTER (WHERE o_orderkey % 3 > 0) >= 0.6 * count(*) AS is_review, 112.0::DOUBLE AS cut FROM orders GROUP BY 1")
def review_detection(spark, folder):
    pages = _review_pages(spark, folder)
    return review.reviews(pages).join(review.side_cuts(pages), "document_id")


@query("""SELECT o_orderkey AS page, r.row, r.side, r.y, CASE r.row WHEN 1 THEN 'Вопрос' WHEN 2 THEN 'Выберите один ответ' WHEN 3 THEN CASE WHEN o_orderkey % 3 > 0 THEN 'Баллов: 1,00' ELSE 'Отметить' END ELSE o_orderpriority END AS text
FROM orders CROSS JOIN (VALUES (1, true, 10.0::DOUBLE), (2, false, 11), (3, true, 24), (4, false, 40)) AS r("row", side, y)""")
def review_rows(spark, folder):
    pages = review.dealt_pages(_review_pages(spark, folder))
    return review.review_rows(pages, review.side_cuts(pages)).select("page", "row", "side", "y", "text")


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN '0,1' WHEN 2 THEN '' ELSE '' END AS told FROM part""")
def told_options(spark, folder):
    name = F.lower(F.col("p_name"))
    feedback = F.element_at(F.array(F.concat(F.lit("«"), F.upper("p_name"), F.lit("».")), F.concat(F.lit("first of "), name, F.lit("; "), name), F.lit("quite another answer altogether"), F.lit("")), F.col("p_size") % 4 + 1)
    options = F.array(F.concat(F.lit("First of "), name), F.col("p_name"), F.lit("zzz"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array_join(review.told_options(feedback, options), ",").alias("told"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name || '|z|y' WHEN p_size % 3 = 1 THEN p_name || '|?|?' ELSE p_name || '|y|z' END AS known FROM part""")
def solved_rows(spark, folder):
    size, no = F.col("p_size"), F.lit(None).cast("string")
    entry = lambda value, wrong: F.struct(value.alias("value"), wrong.alias("wrong"))
    entries = F.array(entry(F.col("p_name"), F.lit(False)), entry(F.lit("y"), size % 3 == 0), entry(F.lit("y"), size % 3 == 2))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", F.lit("y"), F.lit("z")).alias("values"), entries.alias("entries"), F.array(F.col("p_name"), no, no).alias("known"))
    return review.solve_remaining(rows).select("id", F.array_join("known", "|", "?").alias("known"))


@query("SELECT vec_id AS picture_id, min(vec_id) OVER (PARTITION BY vec_id % 10, vec_id // 10 % 3 = 2) AS of FROM embeddings")
def picture_clusters(spark, folder):
    kind = F.floor(F.col("vec_id") / 10) % 3
    fine = F.when(kind == 0, "0" * 32).when(kind == 1, "0" * 31 + "1").otherwise("f" * 32)
    return review.picture_clusters(table(spark, folder, "embeddings").select((F.col("vec_id") % 10).alias("document_id"), F.col("vec_id").alias("picture_id"), fine.alias("fine")))


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey AS id, o_custkey % 2 = 0 AS single, o_orderstatus = 'F' AS complete, o_orderkey % 4 AS r, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 1) % 4 END AS w, o_orderkey % 2 AS earned, o_orderstatus <> 'O' AS knows FROM orders),
s AS (SELECT key, r AS answer, count(*) AS n, min(id) AS fst FROM a WHERE complete GROUP BY 1, 2), b AS (SELECT key, arg_max(answer, (n, -fst)) AS best, count(*) AS n_sets FROM s GROUP BY 1),
k AS (SELECT key, any_value(single) AS single, list_sort(list(DISTINCT r) FILTER (WHERE knows)) AS rs, list_sort(list(DISTINCT w) FILTER (WHERE w IS NOT NULL)) AS ws, arg_min(r, id) FILTER (WHERE earned > 0) AS guess FROM a GROUP BY 1),
j AS (SELECT k.*, best, n_sets, list_filter([0, 1, 2, 3], lambda i: NOT list_contains(coalesce(ws, []), i)) AS lft FROM k LEFT JOIN b USING (key)),
g AS (SELECT *, CASE WHEN guess IS NOT NULL AND NOT list_contains(coalesce(ws, []), guess) THEN guess::VARCHAR ELSE '' END AS gs FROM j)
SELECT key, CASE WHEN best IS NOT NULL THEN best::VARCHAR WHEN len(rs) > 0 THEN array_to_string(rs, ',') WHEN single AND len(lft) = 1 THEN lft[1]::VARCHAR ELSE gs END AS answer,
 CASE WHEN n_sets > 1 THEN 'needs_review' WHEN n_sets = 1 THEN 'answered' WHEN len(rs) > 0 THEN CASE WHEN single OR len(rs) + len(coalesce(ws, [])) = 4 THEN 'answered' ELSE 'needs_review' END
  WHEN single AND len(lft) = 1 THEN 'answered' WHEN gs <> '' THEN 'needs_review' ELSE 'missing_answer' END AS status, coalesce(n_sets, 0) AS n_sets FROM g""")
def review_choices(spark, folder):
    key, none = F.col("o_orderkey"), F.array().cast("array<int>")
    at = lambda x: F.array((x % 4).cast("int"))
    attempts = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), key.alias("id"), F.lit(4).alias("n_options"), (F.col("o_custkey") % 2 == 0).alias("single"), (F.col("o_orderstatus") == "F").alias("complete"),
        F.when(F.col("o_orderstatus") != "O", at(key)).otherwise(none).alias("right"), F.when(key % 3 == 0, at(key + 1)).otherwise(none).alias("wrong"), at(key).alias("picked"), (key % 2).alias("earned"),
    )
    return review.resolve_choices(attempts)


@query("""WITH a AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderpriority AS text, o_orderstatus AS s FROM orders), c AS (SELECT key, text, count(*) AS n, min(id) AS fst FROM a WHERE s = 'F' GROUP BY 1, 2),
b AS (SELECT key, arg_max(text, (n, -fst)) AS best, count(*) AS kinds FROM c GROUP BY 1), g AS (SELECT key, arg_min(text, id) AS guess FROM a WHERE s <> 'P' AND (key, text) NOT IN (SELECT (key, text) FROM a WHERE s = 'P') GROUP BY 1)
SELECT key, coalesce(best, guess) AS answer, CASE WHEN kinds = 1 THEN 'answered' WHEN kinds > 1 OR guess IS NOT NULL THEN 'needs_review' ELSE 'missing_answer' END AS status FROM (SELECT DISTINCT key FROM a) LEFT JOIN b USING (key) LEFT JOIN g USING (key)""")
def review_texts(spark, folder):
    status = F.col("o_orderstatus")
    return review.resolve_texts(table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), (status == "F").alias("complete"), (status == "P").alias("wrong")))


@query("""SELECT o_custkey AS key, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS entry, arg_min(o_totalprice::VARCHAR, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders GROUP BY 1, 2""")
def merged_entries(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("entry"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string")).alias("value"))
    return review.merge_structured(rows)


@query("SELECT n_nationkey AS id, n_nationkey AS template_id, CASE WHEN n_nationkey % 3 = 0 THEN r_name || '|old map' ELSE r_name || '|new  map' END AS words FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 > 0".replace("new  map", "new map"))
def adopted_sentences(spark, folder):
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    templates = rows.select(F.col("n_nationkey").alias("template_id"), F.concat("n_name", F.lit(" («x») lies in ___ on the ___ (see?)")).alias("stem"))
    filled = F.concat("n_name", F.lit(" (x)  lies in «"), "r_name", F.lit("» on the "), F.when(F.col("n_nationkey") % 3 == 0, "old map").otherwise("new  map"), F.lit(" (see?)."))
    text = F.when(F.col("n_nationkey") % 5 > 0, filled).otherwise(F.concat("n_name", F.lit(" lies elsewhere")))
    return review.adopt_unboxed(rows.select(F.col("n_nationkey").alias("id"), text.alias("text")), templates).select("id", "template_id", F.array_join("words", "|").alias("words"))


def _lines(spark, folder):
    """Lines of orders with their largest quantity, an order's in one task."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return dealt(rows, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))


@query("""WITH b AS (SELECT n.l_orderkey * 10 + n.l_linenumber AS note_id, q.l_linenumber AS question_id, least(n.l_quantity * 4 + 10, q.l_linenumber * 30 + 25 + 20) - greatest(n.l_quantity * 4, q.l_linenumber * 30 - 6) AS o FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) n JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) q USING (l_orderkey))
SELECT note_id, arg_max(question_id, (o, -question_id)) AS question_id FROM b WHERE o > -40 GROUP BY 1""")
def note_owners(spark, folder):
    rows = _lines(spark, folder)
    notes = rows.select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"), (F.col("q") * 4).alias("y"), F.lit(10.0).alias("h"))
    questions = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("question_id"), (F.col("l_linenumber") * 30).cast("double").alias("top"), (F.col("l_linenumber") * 30 + 25).cast("double").alias("bottom"))
    return geometry.owners(notes, questions)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey AS k, min(q) * 4 AS y FROM r GROUP BY 1),
b AS (SELECT k, l_linenumber AS o, abs(y + 0.62 * 10 - (l_linenumber * 40 + 5)) AS g FROM s JOIN r ON l_orderkey = k), m AS (SELECT k, min((round(g, 6), o)) AS b FROM b GROUP BY 1),
n AS (SELECT k, min((round(abs(y - l_linenumber * 40), 6), l_linenumber)) AS b FROM s JOIN r ON l_orderkey = k WHERE abs(y - l_linenumber * 40) <= 20 GROUP BY 1)
SELECT m.k AS stamp_id, CASE WHEN struct_extract_at(m.b, 1) < 14 THEN struct_extract_at(m.b, 2) END AS option_id, struct_extract_at(n.b, 2) AS row_id FROM m LEFT JOIN n ON m.k = n.k""")
def stamps_and_notes(spark, folder):
    rows = _lines(spark, folder)
    order, line = F.col("l_orderkey"), (F.col("l_linenumber") * 40).cast("double")
    at = rows.groupBy("l_orderkey").agg((F.min("q") * 4).alias("y"))
    stamps = at.select(order.alias("page"), order.alias("question_id"), order.alias("stamp_id"), "y", F.lit(10.0).alias("h"))
    options = rows.select(order.alias("page"), order.alias("question_id"), F.col("l_linenumber").alias("option_id"), line.alias("y"), (line + 10).alias("bottom"))
    noted = geometry.note_rows(at.select(order.alias("question_id"), order.alias("note_id"), "y"), rows.select(order.alias("question_id"), F.col("l_linenumber").alias("row_id"), line.alias("y")))
    return geometry.stamped_options(stamps, options).join(noted.withColumnRenamed("note_id", "stamp_id"), "stamp_id", "left")


@query("""WITH l AS (SELECT o_custkey AS page, o_orderkey AS pos, (o_orderkey // 7 % 4)::INTEGER AS n FROM orders), c AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY page ORDER BY pos) <> n, true) OR n < 2 AS brk FROM l),
r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page ORDER BY pos) AS run FROM c) SELECT page, min(pos) AS first, max(pos) AS last, n AS n_cells FROM r WHERE n >= 2 GROUP BY page, run, n HAVING count(*) >= 2""")
def table_runs(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos"), (F.floor(F.col("o_orderkey") / 7) % 4).cast("int").alias("n_cells"))
    return geometry.table_runs(rows)


@query("SELECT n_nationkey AS page, 1::BIGINT AS word, n_name AS str, 10.0::DOUBLE AS x, 7.0::DOUBLE AS y, 6.0 * length(n_name)::DOUBLE AS w FROM nation UNION ALL SELECT n_nationkey, 3, 'next', 12 + 6.0 * length(n_name), 7, 24 FROM nation")
def joined_glyphs(spark, folder):
    name = F.col("n_name")
    glyph = lambda s, x, w: F.struct(s.alias("str"), x.cast("double").alias("x"), w.cast("double").alias("w"))
    letters = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c, i: glyph(c, 10 + 6 * i, F.lit(6)))
    end = 10 + 6 * F.length(name)
    items = F.concat(letters, F.array(glyph(F.lit(" "), end, F.lit(2)), glyph(F.lit("next"), end + 2, F.lit(24))))
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").alias("page"), F.posexplode(items).alias("pos", "g")).select("page", "pos", "g.*", F.lit(7.0).alias("y"), F.lit(10.0).alias("h"))
    return geometry.joined_glyphs(rows)


@query("""SELECT p_partkey AS id, p_size AS number, p_name AS question, CASE WHEN p_size % 2 = 0 THEN 'B' END AS answer, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'medium' END ELSE 'needs-review' END AS confidence,
 CASE WHEN p_size % 2 = 0 THEN 'answered' ELSE 'missing_answer' END AS status, p_brand AS option_b FROM part""")
def parsed_replies(spark, folder):
    size = F.col("p_size")
    answer = F.when(size % 2 == 0, '"b"').when(size % 5 == 0, "null").otherwise('"unknown"')
    more = F.when(size % 3 == 0, ',"D":"d"').otherwise("")
    body = F.concat(F.lit('[{"number":'), size.cast("string"), F.lit(',"question":" '), F.col("p_name"), F.lit('","options":{"a":"x","(B)":" '), F.col("p_brand"), F.lit('","C.":"y"'), more, F.lit('},"correctAnswer":'), answer, F.lit('},{"number":2,"question":""}]'))
    reply = F.when(size % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(size % 4 == 1, F.concat(F.lit('{"questions":'), body, F.lit("}"))).otherwise(body)
    out = records.parse_answers(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), reply.alias("json")))
    return out.select("id", "number", "question", "answer", "confidence", "status", F.col("options")["B"].alias("option_b"))


@query("SELECT c_custkey AS asked, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'n' || (c_nationkey + 1) % 25 ELSE 'n' || c_nationkey END AS title FROM customer WHERE CASE WHEN c_custkey % 3 = 1 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END < 20")
def resolved_titles(spark, folder):
    rows, nation = table(spark, folder, "customer"), F.col("c_nationkey")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    asked = rows.select(F.col("c_custkey").alias("asked"))
    normal = rows.select(F.col("c_custkey").alias("from"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("r"), nation.cast("string"))).otherwise(name(nation)).alias("to"))
    nations = table(spark, folder, "nation")
    redirects = nations.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("from"), name((F.col("n_nationkey") + 1) % 25).alias("to"))
    documents = nations.where("n_nationkey < 20").select(name(F.col("n_nationkey")).alias("title"), F.lit("u").alias("url"))
    return lookup.resolve_titles(asked.select(F.col("asked").cast("string").alias("asked")), normal.withColumn("from", F.col("from").cast("string")), redirects, documents).select(F.col("asked").cast("long").alias("asked"), "title")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_custkey BETWEEN 4 AND 9 AND o_orderkey % 4 < 3""")
def figure_noise(spark, folder):
    key = F.col("o_orderkey")
    stem = F.element_at(F.array(F.lit("наружная вена и артерия"), F.lit("1. вена 2. артерия 3. нерв"), F.lit("отверстие рта 1."), F.lit("Какая структура обеспечивает вентиляцию легких?")), (key % 4 + 1).cast("int"))
    questions = table(spark, folder, "orders").select(key.alias("id"), F.col("o_custkey").alias("page"), stem.alias("question"), F.create_map().cast("map<string,string>").alias("options"))
    figures = spark.sql("SELECT * FROM VALUES (5L, 7L, array('наружная вена', 'артерия')), (9L, 9L, array('нерв')) AS t(first_page, last_page, labels)")
    return records.figure_noise(questions, figures)


# --- figures ---------------------------------------------------------------------------------------------------------


def _placed(texts, left: float = 50.0):
    """Texts as items, one under the other."""
    return F.transform(texts, lambda s, i: F.struct(s.alias("str"), F.lit(left).alias("x"), (20 + 12 * i).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(10.0).alias("h")))


@query("""SELECT n_nationkey::VARCHAR AS document_id, 0 AS figure, 1 AS first_page, 2 AS last_page, n_nationkey::INTEGER AS question_no, 1.0::DOUBLE AS got, 2.0::DOUBLE AS maximum, '1:Вена ' || n_name || '|2:Артерия|3:Нерв' AS labels FROM nation""")
def numbered_figures(spark, folder):
    key = F.col("n_nationkey")
    one = F.concat(F.array(F.lit("Вопрос"), key.cast("string"), F.lit("Баллов:"), F.lit("1,00"), F.lit("из"), F.lit("2,00"), F.lit("1."), F.lit("⟪вена⟫"), F.col("n_name"), F.lit("2."), F.lit("артерия")))
    two = F.array(F.lit("3."), F.lit("нерв"), F.lit("Отметить"), F.lit("вопрос"))
    rows = table(spark, folder, "nation")
    pages = rows.select(key.cast("string").alias("document_id"), F.lit(1).alias("page"), _placed(one).alias("items")).unionByName(rows.select(key.cast("string").alias("document_id"), F.lit(2).alias("page"), _placed(two).alias("items")))
    found = figures.figures(pages)
    shown = F.array_join(F.transform("labels", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["text"])), "|")
    return found.select("document_id", "figure", "first_page", "last_page", "question_no", "got", "maximum", shown.alias("labels"))


@query("SELECT n_nationkey::VARCHAR AS document_id, '1:Жевательная мышца|2:Околоушная железа' AS labels FROM nation WHERE n_nationkey % 4 > 0")
def slide_figures(spark, folder):
    word = lambda s, x, y: F.struct(F.lit(s).alias("str"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(60.0).alias("w"), F.lit(10.0).alias("h"), F.lit(0.9).alias("conf"))
    said = F.when(F.col("n_nationkey") % 4 > 0, "обозначенное на рисунке").otherwise("другое")
    head = F.struct(said.alias("str"), F.lit(10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(60.0).alias("w"), F.lit(10.0).alias("h"), F.lit(0.9).alias("conf"))
    items = F.array(head, word("2", 10, 60), word("околоушная", 20, 61), word("железа,", 85, 60), word("1", 10, 40), word("жевательная", 25, 40), word("мышца", 90, 41), word("3", 10, 80), word("x1", 20, 80))
    found = figures.slide_figures(table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("document_id"), F.lit(1).alias("page"), items.alias("items")))
    return found.select("document_id", F.array_join(F.transform("labels", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["text"])), "|").alias("labels"))


@query("""WITH f AS (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 5)::DOUBLE END AS got FROM orders), g AS (SELECT *, min(id) OVER (PARTITION BY scope, k = 2) AS grp FROM f),
l AS (SELECT grp, id, got, unnest([1, 2, 3]) AS n, k FROM g), v AS (SELECT *, CASE WHEN k = 2 THEN 'nerve ' || n WHEN n = 3 AND k = 1 THEN 'other' ELSE 'vein ' || n END AS value FROM l),
w AS (SELECT grp, n, value, round(sum(CASE WHEN got IS NULL THEN 0.5::DOUBLE ELSE greatest(0.05::DOUBLE, got / 4) END), 6) AS weight, bool_or(coalesce(got >= 4, false)) AS f FROM v GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, n ORDER BY f DESC, weight DESC, value) AS r, count(*) OVER (PARTITION BY grp, n) AS kinds FROM w), a AS (SELECT grp, count(DISTINCT id) AS n, bool_or(coalesce(got >= 4, false)) AS f FROM v GROUP BY 1),
s AS (SELECT r.grp, r.n, value, kinds = 1 OR r.f AS sure FROM r WHERE r = 1)
SELECT s.grp AS "group", s.n, value, sure AND (a.f OR (a.n > 1 AND bool_and(sure) OVER (PARTITION BY s.grp))) AS agreed FROM s JOIN a ON a.grp = s.grp""")
def merged_figures(spark, folder):
    key = F.col("o_orderkey")
    value = lambda n: F.when(key % 3 == 2, f"nerve {n}").when((key % 3 == 1) & F.lit(n == 3), "other").otherwise(f"vein {n}")
    labels = F.array(*[F.struct(F.lit(n).alias("n"), value(n).alias("text")) for n in (1, 2, 3)])
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("scope"), key.alias("id"), labels.alias("labels"), F.lit(None).cast("string").alias("hash"), F.lit(False).alias("from_ocr"),
        F.when(key % 5 > 0, (key % 5).cast("double")).alias("got"), F.lit(4.0).alias("maximum"),
    )
    return figures.merged(rows, figures.figure_groups(rows))


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS d, o_orderkey % 4 + 2 AS page, (o_orderkey % 300)::DOUBLE AS top FROM orders), p AS (SELECT o_custkey AS d, o_orderkey % 5 + 1 AS page, o_orderkey AS image_id, (o_orderkey % 7 * 40)::DOUBLE AS y, (50 + o_orderkey % 60)::DOUBLE AS w, 90.0::DOUBLE AS h FROM orders WHERE o_orderkey % 60 >= 10),
b AS (SELECT id, p.page, image_id, CASE WHEN p.page < f.page THEN 0 WHEN y + h <= top + 40 THEN 2 ELSE 1 END AS rank, w * h AS area FROM f JOIN p ON f.d = p.d AND p.page IN (f.page, f.page - 1))
SELECT id AS figure_id, arg_max(page, (rank, area, -image_id)) AS page, arg_max(image_id, (rank, area, -image_id)) AS image_id FROM b GROUP BY 1""")
def figure_images(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders")
    found = rows.select(key.alias("figure_id"), F.col("o_custkey").alias("document_id"), (key % 4 + 2).alias("page"), (key % 300).cast("double").alias("top"))
    pictures = rows.select(F.col("o_custkey").alias("document_id"), (key % 5 + 1).alias("page"), key.alias("image_id"), (key % 7 * 40).cast("double").alias("y"), (50 + key % 60).cast("double").alias("w"), F.lit(90.0).alias("h"))
    return figures.images(found, pictures)


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT c::VARCHAR AS document_id, 'choice' AS kind, 'Which is ' || c || '?' AS stem, 'alpha|beta|gamma delta' AS options, '1' AS answer, 'answered' AS status, count(*) AS attempts FROM o WHERE total >= 2 GROUP BY 1, c
UNION ALL SELECT c::VARCHAR, 'text', 'Name of ' || c || ' is', '', CASE WHEN count(*) FILTER (WHERE n % 2 = 1) > 0 THEN 'vein' END, 'answered', count(*) FROM o WHERE total >= 2 GROUP BY 1, c""")
def review_questions(spark, folder):
    """Two questions on each page, a choice and a text, read from customers of two orders and more."""
    key, name = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    item = lambda text, x, y: F.struct((text if not isinstance(text, str) else F.lit(text)).alias("str"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"))
    items = F.array(
        item("Вопрос", 20, 10), item("7", 60, 10), item("Верно", 20, 24), item("Баллов: 1,00", 20, 38), item("из 1,00", 80, 38), item(F.concat(F.lit("Which is "), name, F.lit("?")), 20, 60),
        item("Выберите один ответ:", 20, 80), item("□", 20, 100), item("a. alpha", 40, 100), item("■", 20, 120), item("b. beta", 40, 120), item("", 90, 120), item("□", 20, 140), item("c. gamma", 40, 140), item("delta", 40, 152),
        item("Вопрос", 20, 200), item("8", 60, 200), item(F.when(key % 2 == 0, "Неверно").otherwise("Верно"), 20, 214), item("Баллов: 1,00 из 1,00", 20, 228), item(F.concat(F.lit("Name of "), name, F.lit(" is")), 20, 250),
        item("Ответ: ⟪vein⟫", 20, 270), item("Тест начат вчера", 20, 300), item("chrome", 20, 320),
    )
    pages = table(spark, folder, "orders").select(name.alias("document_id"), key.cast("int").alias("page"), items.alias("items"))
    found = review.extract(pages)
    letters = F.array_join("options", "|")
    return found.select("document_id", "kind", "stem", letters.alias("options"), "answer", "status", "attempts")
