"""Queries of the screens: filters, counters, orders, parts of files and the pool of a quiz."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records, views
from ..operators.bank import answer_keys
from ..sources import adapters, spread, table
from .registry import query

_F = """f AS (SELECT *, CASE WHEN answer IS NULL THEN 'missing_answer' WHEN p_size % 5 = 1 THEN 'needs_review' ELSE 'answered' END AS status, coalesce(answer IN ('A', 'B'), false) AS has FROM (
 SELECT p_partkey AS id, p_name AS question, p_brand AS a, p_type AS b, CASE WHEN p_size % 3 <> 0 THEN ['A', 'B', 'Z'][(p_size % 3 + 1)::INT] END AS answer, p_size,
 CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'needs-review' END AS confidence, CASE WHEN p_size % 7 = 0 THEN 'img' || p_size END AS image_id, p_size % 11 = 0 AS tagged FROM part))"""
_KEY = r"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_CONFIRMED = "CASE WHEN l_suppkey % 4 = 3 THEN 1 ELSE 0 END"


def _has(rows):
    return records.has_answer(F.col("answer"), F.map_keys("options"), F.lit(None).cast("string"))


def _pairs(*columns: str):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("text")) for k, c in zip("ABCDE", columns, strict=False)])


@query(f"WITH {_F} SELECT id, question FROM f WHERE confidence = 'needs-review' AND (contains(id::VARCHAR, '1') OR contains(lower(question), '1') OR contains(lower(a), '1') OR contains(lower(b), '1'))")
def review_screen(spark, folder):
    return views.review_screen(adapters.flat_rows(spark, folder), "needs_review", " 1 ").select("id", "question")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS attempt, l_quantity::INT % 3 AS e, l_suppkey % 4 AS a FROM lineitem)
SELECT 'review' AS shown, l_orderkey AS document_id, count(*) AS n FROM i WHERE attempt = 1 AND (e = 1 OR a IN (0, 1)) GROUP BY 2 UNION ALL SELECT 'failed', l_orderkey, count(*) FROM i WHERE e = 2 GROUP BY 2
UNION ALL SELECT 'noanswer', l_orderkey, count(*) FROM i WHERE a = 2 GROUP BY 2""")
def document_instance_filters(spark, folder):
    rows = adapters.instance_rows(spark, folder)
    out = [views.document_instances(rows, attempt, shown).groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit(shown).alias("shown"), "document_id", "n") for attempt, shown in ((1, "review"), (None, "failed"), (None, "noanswer"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_F} SELECT id, image_id IS NOT NULL OR tagged AS figure FROM f")
def figure_questions(spark, folder):
    rows = adapters.flat_rows(spark, folder)
    marked = [views.quiz_mode(rows, mode).select("id", F.lit(mode == "figures").alias("figure")) for mode in ("figures", "text")]
    return marked[0].unionByName(marked[1])


@query(f"WITH {_F} SELECT id FROM f WHERE (NOT has OR id % 4 = 0) AND id % 3 < 2 AND id % 9 <> 0 AND length(trim(question)) >= 3")
def lookup_targets(spark, folder):
    rows = adapters.flat_rows(spark, folder).withColumn("has_answer", _has(None))
    rows = rows.withColumn("origin", F.when(F.col("id") % 4 == 0, "ai")).withColumn("lookup_version", (F.col("id") % 3).cast("int"))
    return views.lookup_targets(rows, rows.where("id % 9 = 0"), 2).select("id")


@query(f"WITH {_F} SELECT id, id::VARCHAR AS raw_number, answer AS correct_answer, CASE WHEN p_size % 4 = 0 THEN 'typed' END AS answer_text, CASE WHEN answer IS NOT NULL OR p_size % 4 = 0 THEN 'answered' ELSE 'missing_answer' END AS status, a AS option_a FROM f")
def flat_questions(spark, folder):
    rows = adapters.flat_rows(spark, folder)
    nested = rows.select("id", "number", "question", F.map_entries("options").alias("options"), F.struct(F.col("answer").alias("key"), F.col("answer_text").alias("text")).alias("answer"))
    return views.flat(nested).select("id", "raw_number", "correct_answer", "answer_text", "status", F.col("options")["A"].alias("option_a"))


@query("""SELECT p_partkey AS id, n >= 2 AS valid, CASE WHEN answer AND n >= 4 THEN 'high' WHEN answer THEN 'medium' ELSE 'needs-review' END AS confidence, CASE WHEN answer THEN 'answered' ELSE 'missing_answer' END AS status
FROM (SELECT p_partkey, p_size % 6 AS n, p_size % 4 > 0 AS answer FROM part)""")
def editor_checks(spark, folder):
    size = F.col("p_size")
    options = F.concat(F.array_repeat(F.lit("x"), (size % 6).cast("int")), F.array(F.lit("  ")))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), views.edited(options, F.when(size % 4 > 0, "A")).alias("e")).select("id", "e.*")


_LABELS = "('CONFLICT', 'Contradicting answers', 'red'), ('UNRESOLVED', 'No answer', 'grey'), ('NEEDS_REVIEW', 'To review', 'amber')"


@query(f"""SELECT p_partkey AS id, s AS answer_status, coalesce(label, s) AS label, tone FROM (SELECT p_partkey, ['CONFLICT', 'NEEDS_REVIEW', 'UNRESOLVED', 'CONFIRMED_BY_SCORE'][(p_size % 4 + 1)::INT] AS s FROM part)
LEFT JOIN (VALUES {_LABELS}) AS t(value, label, tone) ON value = s""")
def status_labels(spark, folder):
    labels = spark.sql(f"SELECT * FROM VALUES {_LABELS} AS t(value, label, tone)")
    return views.labelled(adapters.canonical_rows(spark, folder).select("id", "answer_status"), "answer_status", labels)


@query(f"""WITH {_F} SELECT count(*) AS "all", count(*) FILTER (WHERE status = 'answered') AS answered, count(*) FILTER (WHERE status = 'missing_answer') AS missing_answer,
 count(*) FILTER (WHERE confidence = 'needs-review') AS needs_review, count(*) FILTER (WHERE confidence = 'high') AS high_confidence FROM f""")
def extraction_stats(spark, folder):
    return views.extraction_stats(adapters.flat_rows(spark, folder))


@query(f"""WITH {_F}, u AS (SELECT question || '|' || b AS key, arg_min(has, id) AS has FROM f GROUP BY 1)
SELECT 'documents' AS name, count(*) AS n FROM orders UNION ALL SELECT 'unique', count(*) FROM u UNION ALL SELECT 'answered', count(*) FROM u WHERE has UNION ALL SELECT 'missing', count(*) FROM u WHERE NOT has
UNION ALL SELECT 'figures', count(*) FROM f WHERE image_id IS NOT NULL OR tagged""")
def dashboard_numbers(spark, folder):
    rows = adapters.flat_rows(spark, folder)
    key = F.concat("question", F.lit("|"), F.col("options")["B"])
    return views.dashboard(adapters.document_rows(spark, folder), rows, key, _has(rows), views.is_figure(F.col("image_id"), F.col("tags")))


@query(f"""SELECT l_orderkey AS document_id, ['CONFLICT', 'NEEDS_REVIEW', 'UNRESOLVED', 'CONFIRMED_BY_SCORE'][(l_suppkey % 4 + 1)::INT] AS answer_status, count(*) AS n,
 (sum(sum({_CONFIRMED})) OVER (PARTITION BY l_orderkey))::BIGINT AS answered FROM lineitem GROUP BY 1, 2, l_suppkey % 4""")
def document_counters(spark, folder):
    return views.document_counters(adapters.instance_rows(spark, folder))


@query("SELECT o_custkey AS owner, median(o_totalprice) AS median, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS upper FROM orders GROUP BY 1")
def medians(spark, folder):
    return views.medians(table(spark, folder, "orders").withColumnRenamed("o_custkey", "owner"), "owner", "o_totalprice")


@query("SELECT document_id, round(avg(c), 4) AS confidence FROM (SELECT user_id AS document_id, event_type, avg(value) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def mean_confidence(spark, folder):
    return views.mean_confidence(table(spark, folder, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("page"), F.col("value").alias("conf")))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '2,10,x9' WHEN 1 THEN '1,3,a,b' ELSE '' END AS keys, CASE p_size % 3 WHEN 0 THEN 'x9,10,2' WHEN 1 THEN 'А,b,c,C,e' ELSE '' END AS labels FROM part""")
def option_orders(spark, folder):
    size = F.col("p_size")
    given = lambda *texts: F.element_at(F.array(*[F.filter(F.split(F.lit(x), ","), lambda k: k != "") for x in texts]), size % 3 + 1)
    numbered = F.transform(given("10,x9,2", "b,3,a,1", ""), lambda k: F.struct(k.alias("key")))
    lettered = F.transform(given("x9,10,2", "e,c,b,А,C", ""), lambda k: F.struct(k.alias("label")))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(F.transform(views.natural_order(numbered), lambda o: o["key"]), ",").alias("keys"),
        F.array_join(F.transform(views.label_order(lettered), lambda o: o["label"]), ",").alias("labels"),
    )


@query(r"""WITH w AS (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) >= 4) AS t FROM benchmark)),
d AS (SELECT item_id, w, min(i) AS i FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM d)
SELECT item_id, coalesce(string_agg(w, ',' ORDER BY k) FILTER (WHERE k <= 6), '') AS words FROM benchmark LEFT JOIN r USING (item_id) GROUP BY item_id""")
def longest_keywords(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.array_join(views.keywords(F.col("text")), ",").alias("words"))


@query("""SELECT figure_id, arg_max(image_id, (area, -image_id)) AS image_id FROM (SELECT o_orderkey AS figure_id, l_linenumber AS image_id, l_quantity * l_extendedprice AS area
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount * 1000 + l_extendedprice / 2 < o_totalprice / 2) GROUP BY 1""")
def largest_image_above(spark, folder):
    figures = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("figure_id"), (F.col("o_totalprice") / 2).alias("top"))
    images = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("image_id"), (F.col("l_discount") * 1000).alias("y"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("h"))
    return views.largest_image(figures, images)


@query("""WITH p AS (SELECT 0 AS k, o_orderkey AS id, o_custkey AS document, o_orderkey AS sequence FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT id, document, k * 1000000 + sequence AS place, (row_number() OVER (PARTITION BY document ORDER BY k * 1000000 + sequence))::INTEGER AS number FROM p""")
def joined_and_renumbered(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("s"))
    both = views.joined_parts(rows.where("s = 'F'").drop("s"), rows.where("s = 'O'").drop("s"))
    return views.renumbered(both, "document", "place").select("id", "document", "place", "number")


@query(f"""WITH k AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE array_to_string(list_sort([x, y]), '|') END AS key FROM (SELECT page_id, {_KEY.format(x="regexp_extract(url, '://([^/?#]*)', 1)")} AS x, 'c ' || page_id % 5 AS y FROM pages))
SELECT page_id FROM (SELECT page_id, key, row_number() OVER (PARTITION BY key ORDER BY page_id) AS r FROM k) WHERE r = 1 OR key = ''""")
def figures_of_files(spark, folder):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    captions = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("—"))).otherwise(F.array(F.concat(F.lit("C. "), (F.col("page_id") % 5).cast("string")), host))
    return views.first_of_key(table(spark, folder, "pages").select("page_id", captions.alias("captions")), views.figure_key(F.col("captions")), "page_id").select("page_id")


@query(f"WITH {_F} SELECT min(id) AS id FROM f WHERE answer IS NOT NULL GROUP BY question, a, b, image_id")
def published_bank(spark, folder):
    rows = adapters.flat_rows(spark, folder).where("answer IS NOT NULL")
    return views.publish(rows.select("id", "question", F.map_values("options").alias("options"), "answer", "image_id")).select("id")


@query("SELECT l_orderkey AS id, string_agg(issue, ',' ORDER BY i) AS issues FROM (SELECT l_orderkey, issue, min((l_linenumber, issue)) AS i FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS issue FROM lineitem) GROUP BY 1, 2) GROUP BY 1")
def distinct_issues(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("issue")))).alias("r"))
    return rows.select("id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["issue"])), ",").alias("issues"))


@query(f"""WITH {_F}, k AS (SELECT *, row_number() OVER (PARTITION BY question, b ORDER BY id) AS r FROM f), q AS (SELECT *, (image_id IS NOT NULL OR tagged) AND (tagged OR NOT has) AS figure FROM k WHERE r = 1 AND (has OR p_size % 13 = 0 OR p_size % 17 = 0))
SELECT id, CASE WHEN p_size % 13 = 0 THEN 'sequence' WHEN p_size % 17 = 0 THEN 'matching' WHEN figure THEN 'figure' ELSE 'choice' END AS kind,
 CASE WHEN p_size % 13 = 0 OR p_size % 17 = 0 THEN '' WHEN figure THEN 'A,B' ELSE answer END AS correct FROM q""")
def quiz_pool(spark, folder):
    rows = adapters.flat_rows(spark, folder)
    size = F.col("p_size")
    slots = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (size % 13 == 0).alias("ordered"), (size % 17 == 0).alias("matching"))
    # the brand is no part of what makes two questions one here, so it is an option's key rather than its text
    options = F.array(F.struct(F.lit("B").alias("key"), F.col("options")["B"].alias("text")), F.struct(F.lit("A").alias("key"), F.lit("none").alias("text")))
    pool = views.quiz_pool(rows.withColumn("options", options).join(slots, "id"))
    return pool.select("id", "kind", F.array_join("correct", ",").alias("correct"))


@query("SELECT p_partkey AS id, greatest(least(p_size, 40), 5)::INTEGER AS clamped, (100.0::DOUBLE * p_size / 50)::DOUBLE AS percent FROM part")
def clamped_percent(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), text.clamp(size, 5, 40).alias("clamped"), text.percent(size, F.lit(50)).alias("percent"))


@query("SELECT l_orderkey AS id, min(l_quantity) AS x, min(l_discount) AS y, max(l_quantity + l_tax) - min(l_quantity) AS w, max(l_discount + l_linenumber) - min(l_discount) AS h FROM lineitem GROUP BY 1")
def union_boxes(spark, folder):
    boxes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("w"), F.col("l_linenumber").alias("h"))
    return text.union_box(boxes, "id")


@query("""WITH b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN vec_id % 3 = 0 AND i > 1 THEN 7 WHEN embedding[i] > 0 THEN 9 ELSE 8 END) AS l FROM embeddings),
c AS (SELECT vec_id, l, list_max(list_transform(range(16), lambda v: {'n': len(list_filter(l, lambda x: x = v)), 'v': -v})) AS m FROM b)
SELECT vec_id, len(list_filter(l, lambda x: abs(x + m['v']) >= 2)) / 64.0::DOUBLE < 0.006 AS blank FROM c""")
def blank_pictures(spark, folder):
    level = lambda i: F.when((F.col("vec_id") % 3 == 0) & (i > 0), "7").when(F.get("embedding", i) > 0, "9").otherwise("8")
    fine = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), level), "")
    return spread(table(spark, folder, "embeddings").select("vec_id", fine.alias("fine")), "vec_id").select("vec_id", text.is_blank_picture(F.col("fine")).alias("blank"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, epoch_ms(ts) > 1704067300000 AS later FROM events")
def iso_timestamps(spark, folder):
    rows = table(spark, folder, "events").select("event_id", text.iso(F.col("ts")).alias("iso"))
    return rows.select("event_id", "iso", (F.unix_millis(F.to_timestamp("iso")) > 1704067300000).alias("later"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'K1=' || n_name || '|R=' || n_regionkey ELSE 'R=' || n_regionkey END AS pairs FROM nation")
def mapped_pairs(spark, folder):
    pairs = F.create_map(F.lit("o1"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.lit("o2"), F.col("n_regionkey").cast("string"))
    names = F.create_map(F.lit("o1"), F.lit("K1"), F.lit("o2"), F.lit("R"), F.lit("o3"), F.lit("never"))
    out = text.renamed_pairs(pairs, names)
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("pairs"))
