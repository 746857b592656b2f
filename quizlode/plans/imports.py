"""Queries of imports, stored pictures, feedback lines and unlabelled items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import feedback, grouping, layout, pictures
from ..sources import adapters, saved_bank, spread, table, work_folder
from ..sources.stages import StageLog
from .registry import query


def _median(rows: DataFrame, column: str) -> float | None:
    """The exact median of a column. No task holds all values: quantiles tell where it lies, and only what is between them is counted."""
    x = F.col(column)
    for width in (0.001, 0.01, 0.5):
        told = rows.agg(F.percentile_approx(x, F.array(F.lit(0.5 - width), F.lit(0.5 + width))).alias("q"), F.count(x).alias("n")).first()
        if not told.n:
            return None
        low, high = told.q
        below = rows.where(x < F.lit(low)).count()
        between = rows.where(x.between(low, high)).groupBy(x.alias("v")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("v")) + below)
        middle = [(told.n - 1) // 2, told.n // 2]
        found = between.agg(*[F.min(F.when(F.col("upto") > m, F.col("v"))) for m in middle]).first()
        if below <= middle[0] and found[1] is not None:
            return (found[0] + found[1]) / 2
    raise RuntimeError(f"no median of {column}")


@query("""SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS canonical_id, o_orderkey > (SELECT median(o_orderkey) FROM orders) AS second FROM orders""")
def incremental_import(spark, folder):
    """A question for each order, told by its customer and written in one of two ways, imported in two steps by order."""
    orders = table(spark, folder, "orders")
    word = F.translate(F.md5(F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))), "0123456789", "ghijklmnop")
    half = _median(orders, "o_orderkey")
    stem = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Is it "), word, F.lit("?"))).otherwise(F.concat(F.lit("is it  "), F.upper(word)))
    rows = orders.select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("document_id"), F.col("o_orderkey").alias("sequence"), stem.alias("stem"), F.concat(F.lit("is it "), word).alias("key"),
        F.array(F.lit("yes"), F.lit("no")).alias("options"), F.lit("SINGLE_CHOICE").alias("type"), (F.col("o_orderkey") > F.lit(half)).alias("second"),
    )
    store = work_folder(spark, "groups")
    out = None
    for second in (False, True):
        part = grouping.import_questions(rows.where(F.col("second") == second).drop("second"), store).select("id", "canonical_id", F.lit(second).alias("second"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT page_id, sha256(html) AS id, strlen(html)::BIGINT AS length FROM pages""")
def stored_pictures(spark, folder):
    """The pages' bytes as pictures, put in two steps that share some; each content is kept once."""
    store = work_folder(spark, "pictures")
    rows = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").cast("binary").alias("content"))
    names = pictures.put(spark, store, rows.where("length(name) <= 3")).unionByName(pictures.put(spark, store, rows)).distinct()
    found = names.where("id IS NOT NULL").join(pictures.get(spark, store, names.where("id IS NOT NULL")), "id")
    return found.select(F.col("name").cast("long").alias("page_id"), "id", "length")


_FIRST = "split_part(p_name, ' ', 1)"


@query(f"""SELECT p_partkey AS id,
 CASE p_size % 4 WHEN 0 THEN '2,0,1' WHEN 1 THEN '0' ELSE '' END AS told,
 CASE WHEN p_size % 4 = 0 THEN '2,0,1' WHEN p_size % 4 = 1 THEN '0' END AS right_order,
 CASE WHEN p_size % 4 = 2 THEN '0=' || p_brand || '|1=' || p_type END AS pairs,
 CASE p_size % 4 WHEN 2 THEN {_FIRST} || ' -> ' || p_type || '; ' || p_name || ' → ' || p_brand WHEN 3 THEN 'quite another answer' END AS text_answer FROM part""")
def feedback_intervals(spark, folder):
    """A longer option takes its stretch before one that is its first word; an order goes by first places."""
    first = F.substring_index("p_name", " ", 1)
    value = adapters._one_of(
        F.col("p_size"), F.concat(F.upper("p_brand"), F.lit(", «"), F.col("p_name"), F.lit("» and "), first), F.concat(F.upper("p_name"), F.lit(".")),
        F.concat(first, F.lit(" -> "), F.col("p_type"), F.lit("; "), F.col("p_name"), F.lit(" → "), F.col("p_brand")), F.lit("quite another answer"),
    )
    rows = spread(table(spark, folder, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), value.alias("value"), F.array(F.col("p_name"), first, F.col("p_brand")).alias("options"))
    rows = rows.select("id", feedback.named(F.col("value"), F.col("options"), F.lit("ORDERING")).alias("f"))
    pair = F.array_sort(F.transform(F.map_entries("f.pairs"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])))
    return rows.select("id", F.array_join("f.told", ",").alias("told"), F.array_join("f.right_order", ",").alias("right_order"), F.array_join(pair, "|").alias("pairs"), "f.text_answer")


@query("""WITH l AS (SELECT l_orderkey AS block, l_linenumber AS pos, 1 + (l_linenumber > 4)::INT AS page, l_linenumber * 14 + l_suppkey % 2 * 6 AS y, 10 + l_linenumber AS h FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
g AS (SELECT *, CASE WHEN lag(page) OVER w <> page THEN NULL ELSE y - lag(y + h) OVER w END AS gap, lag(page) OVER w <> page AS across, lag(page) OVER w IS NULL AS head, first(h) OVER w AS fh FROM l WINDOW w AS (PARTITION BY block ORDER BY pos)),
m AS (SELECT *, greatest(coalesce(max(gap) OVER b, 0), 0) AS most, min(gap) OVER b AS least FROM g WINDOW b AS (PARTITION BY block)),
j AS (SELECT *, CASE WHEN head OR across OR least IS NULL THEN 1 WHEN most - least > greatest(fh * 0.35, 2) AND gap < 0.6 * most THEN 0 ELSE 1 END AS begins FROM m)
SELECT block, pos, (sum(begins) OVER (PARTITION BY block ORDER BY pos) - 1)::INT AS item FROM j""")
def rhythm_blocks(spark, folder):
    items, n = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")), F.col("l_linenumber")
    lines = items.select(
        F.col("l_orderkey").alias("block"), n.alias("pos"), F.when(n > 4, 2).otherwise(1).alias("page"), (n * 14 + F.col("l_suppkey") % 2 * 6).alias("y"), (n + 10).alias("h")
    )
    return layout.rhythm_blocks(lines).select("block", "pos", "item")


@query("""SELECT p_partkey::VARCHAR AS id, p_size::INTEGER AS number, 'Which ' || p_name || ' is it?' AS question, 'A=' || p_brand || '|B=' || p_type AS options,
 CASE WHEN p_size % 3 = 0 THEN '' ELSE 'B' END AS key, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS answer,
 CASE WHEN p_size % 2 = 1 THEN 0.5::DOUBLE WHEN p_size % 3 = 0 THEN round((0.99 + 0.6 + 0.5) / 3, 2)::DOUBLE ELSE round((0.99 + 0.6 + 0.99) / 3, 2)::DOUBLE END AS overall,
 CASE WHEN p_size % 2 = 1 THEN 'review' WHEN p_size > 25 THEN 'verified' ELSE 'pending' END AS status FROM part""")
def saved_bank_upgraded(spark, folder):
    """Parts as a saved bank, half of them in either shape, with scores left in the texts; read again as questions."""
    name, score = F.col("p_name"), F.lit(" Балл: 1,00")
    part = table(spark, folder, "part").withColumn("stem", F.concat(F.lit("Which "), name, F.lit(" is it?"), score))
    has = F.col("p_size") % 3 != 0
    listed = F.array(F.struct(F.lit("A").alias("key"), F.concat("p_brand", score).alias("text")), F.struct(F.lit("B").alias("key"), F.col("p_type").alias("text")))
    whole = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("questionNumber"), F.struct(F.col("stem").alias("text")).alias("question"), listed.alias("options"),
        F.when(has, F.struct(F.lit("B").alias("key"), F.concat(name, score).alias("text"))).alias("answer"), F.struct(F.lit(0.5).alias("overall"), F.lit("low").alias("level")).alias("confidence"), F.lit("review").alias("status"),
    )
    flat = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("string").alias("number"), F.col("stem").alias("question"), F.create_map(F.lit("B"), F.col("p_type"), F.lit("A"), F.concat("p_brand", score)).alias("options"),
        F.when(has, F.lit("B")).alias("correctAnswer"), F.when(F.col("p_size") > 25, "high").otherwise("medium").alias("confidence"),
    )
    path = work_folder(spark, "saved")
    part.select(F.when(F.col("p_size") % 2 == 1, F.to_json(whole)).otherwise(F.to_json(flat)).alias("value")).write.text(path)
    rows = saved_bank.load(spark, path, lines=True)
    options = F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["key"], o["text"])), "|")
    return rows.select("id", "number", "question", options.alias("options"), F.coalesce("answer.key", F.lit("")).alias("key"), F.col("answer.text").alias("answer"), F.col("confidence.overall").alias("overall"), "status")


@query("""SELECT 'orders' AS stage, count(*)::BIGINT AS rows, max(o_orderkey)::VARCHAR AS latest FROM orders UNION ALL SELECT 'open', count(*)::BIGINT, NULL FROM orders WHERE o_orderstatus = 'O'""")
def stage_log(spark, folder):
    log, path = StageLog(), work_folder(spark, "stages")
    orders = log.kept(table(spark, folder, "orders"), f"{path}/orders", latest=F.max("o_orderkey"))
    log.kept(orders.where("o_orderstatus = 'O'"), f"{path}/open")
    return log.table(spark).where("ms >= 0").select("stage", "rows", F.col("details")["latest"].alias("latest"))
