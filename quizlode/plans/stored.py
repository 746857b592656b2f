"""Queries of the store: lists, joins and changes of documents, instances and canonical questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..sources import adapters, table
from .registry import query

_D = "d AS (SELECT o_orderkey AS document_id, 'file' || o_custkey AS filename, o_orderpriority AS subject, o_orderstatus AS stage, o_orderdate AS created_at FROM orders)"
_ANSWER = "['CONFLICT', 'NEEDS_REVIEW', 'UNRESOLVED', 'CONFIRMED_BY_SCORE'][({x} % 4 + 1)::INT]"
_C = f"""c AS (SELECT p_partkey AS id, p_name AS stem, p_brand AS subject, p_type AS question_type, {_ANSWER.format(x='p_size')} AS answer_status, 'PENDING' AS review_status, p_size % 2 = 0 AS in_bank,
 p_size / 50::DOUBLE AS confidence, p_retailprice AS updated_at, ['A', 'B', 'C'][(p_size % 3 + 1)::INT] AS key, p_size FROM part)"""
_I = f"""i AS (SELECT l_orderkey AS document_id, l_suppkey % 3 AS attempt_id, l_linenumber AS sequence, l_partkey AS canonical_id, ['PARSED', 'NEEDS_REVIEW', 'FAILED'][(l_quantity::INT % 3 + 1)::INT] AS extraction_status,
 {_ANSWER.format(x='l_suppkey')} AS answer_status, l_quantity::BIGINT AS votes FROM lineitem)"""
_T = """t AS (SELECT event_id AS task_id, event_id % 400 AS canonical_id, user_id AS document_id, CASE event_type WHEN 'error' THEN 'POSSIBLE_DUPLICATE' ELSE upper(event_type) END AS kind,
 CASE WHEN value > 50 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM events)"""


@query(f"WITH {_C} SELECT id, stem, updated_at FROM c WHERE answer_status = 'NEEDS_REVIEW' AND NOT in_bank AND contains(lower(stem), 'ring') ORDER BY updated_at DESC, id LIMIT 100 OFFSET 3")
def canonical_list(spark, folder):
    found = store.canonicals(adapters.canonical_rows(spark, folder), answer_status="NEEDS_REVIEW", in_bank=False, query="RING")
    return store.canonical_page(found, 100, 3).select("id", "stem", "updated_at")


@query("""SELECT p_partkey AS id, p_name AS question FROM part WHERE (contains(lower(p_name), '2') OR contains(lower(p_brand), '2') OR contains(lower(p_type), '2')) AND p_size % 3 = 0 AND p_brand = 'Brand#2'
 ORDER BY id LIMIT 20 OFFSET 20""")
def rest_question_page(spark, folder):
    found = store.questions(adapters.flat_rows(spark, folder), "2", "missing_answer", "Brand#2")
    return store.question_page(found, 2, 20).select("id", "question")


@query(f"WITH {_D} SELECT document_id, filename, subject, stage, created_at FROM d ORDER BY created_at DESC, document_id LIMIT 200")
def newest_documents(spark, folder):
    return store.documents(adapters.document_rows(spark, folder))


@query(f"WITH {_D} SELECT document_id, filename FROM d WHERE document_id = 7 UNION ALL SELECT id, stem FROM ({_C.removeprefix('c AS (').removesuffix(')')}) WHERE id = 11")
def point_lookups(spark, folder):
    document = store.by_id(adapters.document_rows(spark, folder), 7, "document_id").select("document_id", "filename")
    question = store.by_id(adapters.canonical_rows(spark, folder), 11).select(F.col("id").alias("document_id"), F.col("stem").alias("filename"))
    return document.unionByName(question)


@query(f"WITH {_I}, {_D} SELECT filename, subject, count(*) AS instances, sum(votes)::BIGINT AS votes FROM i LEFT JOIN (SELECT * FROM d WHERE stage <> 'P') USING (document_id) GROUP BY ALL")
def instances_with_documents(spark, folder):
    joined = store.with_documents(adapters.instance_rows(spark, folder), adapters.document_rows(spark, folder).where("stage <> 'P'"))
    return joined.groupBy("filename", "subject").agg(F.count("*").alias("instances"), F.sum("votes").alias("votes"))


@query(f"WITH {_I}, {_C} SELECT document_id, sequence, canonical_id FROM i WHERE canonical_id IN (SELECT id FROM c WHERE answer_status = 'CONFLICT')")
def members_of_conflicts(spark, folder):
    ids = store.canonicals(adapters.canonical_rows(spark, folder), answer_status="CONFLICT").select(F.col("id").alias("canonical_id"))
    return store.members(adapters.instance_rows(spark, folder), ids).select("document_id", "sequence", "canonical_id")


@query(f"WITH {_I}, {_C} SELECT id AS canonical_id, (row_number() OVER (PARTITION BY id ORDER BY document_id, sequence))::INTEGER AS place FROM c JOIN i ON id = canonical_id UNION ALL SELECT id, NULL FROM c WHERE id NOT IN (SELECT canonical_id FROM i)")
def member_places(spark, folder):
    return store.member_places(adapters.canonical_rows(spark, folder), adapters.instance_rows(spark, folder)).drop("id")


@query("SELECT user_id AS document_id, count(*) AS pages FROM events GROUP BY 1")
def pages_received(spark, folder):
    return store.pages_received(table(spark, folder, "events").withColumnRenamed("user_id", "document_id"))


@query(f"WITH {_I} SELECT DISTINCT document_id, canonical_id FROM i")
def canonicals_of_documents(spark, folder):
    return store.canonical_ids(adapters.instance_rows(spark, folder))


@query("SELECT count(*) AS open FROM events WHERE NOT value > 50")
def open_task_badge(spark, folder):
    return store.open_tasks(adapters.task_rows(spark, folder))


@query("""WITH o AS (SELECT c_custkey AS document_id, c_name AS filename, c_mktsegment AS subject, CASE WHEN c_custkey % 5 = 0 THEN 'ANALYZED' ELSE 'UPLOADED' END AS stage FROM customer WHERE c_custkey % 3 > 0
 UNION ALL SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'ANALYZED' ELSE 'UPLOADED' END FROM customer WHERE c_custkey % 3 = 0)
SELECT document_id, filename, subject, stage, CASE WHEN document_id % 2 = 0 THEN 'blob/' || document_id END AS path FROM o""")
def created_documents(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("subject"))
    old = rows.where("document_id % 3 > 0").withColumn("stage", F.lit("UPLOADED")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    made = store.create_documents(old, rows, F.lit("2024-02-01").cast("timestamp"))
    staged = store.set_stage(made, rows.where("document_id % 5 = 0").select("document_id", F.lit("ANALYZED").alias("stage")))
    files = rows.where("document_id % 2 = 0").select("document_id", F.concat(F.lit("blob/"), F.col("document_id").cast("string")).alias("path"))
    return store.attach_files(staged, files).drop("created_at")


@query(f"WITH {_I} SELECT document_id, count(*) AS questions, count(*) FILTER (WHERE extraction_status = 'PARSED') AS parsed, count(*) FILTER (WHERE extraction_status = 'NEEDS_REVIEW') AS review, count(*) FILTER (WHERE extraction_status = 'FAILED') AS failed, count(*) FILTER (WHERE answer_status <> 'UNRESOLVED') AS answered FROM i WHERE document_id % 3 > 0 OR sequence > 1 GROUP BY 1")
def replaced_analysis(spark, folder):
    rows = adapters.instance_rows(spark, folder)
    again = rows.where("document_id % 3 = 0 AND sequence > 1")
    now = store.replace_analysis(rows, again, rows.where("document_id % 3 = 0").select("document_id"))
    return store.analysis_summary(now)


@query(f"WITH {_D}, {_I} SELECT 'documents' AS name, count(*) AS n FROM d WHERE stage <> 'F' UNION ALL SELECT 'instances', count(*) FROM i WHERE document_id NOT IN (SELECT document_id FROM d WHERE stage = 'F') UNION ALL SELECT 'detail', count(*) FROM i WHERE document_id = 6")
def deleted_documents(spark, folder):
    tables = {"documents": adapters.document_rows(spark, folder), "instances": adapters.instance_rows(spark, folder)}
    left = store.delete_documents(tables, tables["documents"].where("stage = 'F'"))
    left["detail"] = store.detail(tables, 6)["instances"]
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {_C}, {_I} SELECT id, stem, question_type, count(canonical_id) AS n_members, coalesce(sum(votes), 0)::BIGINT AS option_votes FROM c LEFT JOIN i ON id = canonical_id WHERE c.subject = 'Brand#3' GROUP BY 1, 2, 3")
def import_seeds(spark, folder):
    return store.seeds(adapters.canonical_rows(spark, folder), adapters.instance_rows(spark, folder), "Brand#3")


@query(f"""WITH {_C}, {_I}, {_T}, g AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus <> 'O'), lost AS (SELECT DISTINCT canonical_id FROM i WHERE document_id IN (SELECT * FROM g)),
alive AS (SELECT DISTINCT canonical_id FROM i WHERE document_id NOT IN (SELECT * FROM g)), dead AS (SELECT * FROM lost EXCEPT SELECT * FROM alive)
SELECT 'canonical' AS part, id, id IN (SELECT * FROM lost) AS changed FROM c WHERE id NOT IN (SELECT * FROM dead)
UNION ALL SELECT 'instance', document_id, document_id IN (SELECT * FROM g) FROM i UNION ALL SELECT 'task', task_id, false FROM t WHERE document_id NOT IN (SELECT * FROM g) AND canonical_id NOT IN (SELECT * FROM dead)""")
def detached_documents(spark, folder):
    gone = table(spark, folder, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("document_id"))
    canonicals, instances, tasks = store.detach(adapters.canonical_rows(spark, folder), adapters.instance_rows(spark, folder), adapters.task_rows(spark, folder), gone)
    parts = (
        canonicals.select(F.lit("canonical").alias("part"), "id", F.col("touched").alias("changed")),
        instances.select(F.lit("instance").alias("part"), F.col("document_id").alias("id"), F.col("canonical_id").isNull().alias("changed")),
        tasks.select(F.lit("task").alias("part"), F.col("task_id").alias("id"), F.lit(False).alias("changed")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_C}, m AS (SELECT id AS source_id, id - 1 AS target_id FROM c WHERE id % 10 = 1), o AS (SELECT coalesce(target_id, l_partkey) AS canonical_id, l_linenumber AS position, l_returnflag || ' ' || (l_suppkey % 2) AS text, lower(l_returnflag) AS normalized FROM lineitem LEFT JOIN m ON l_partkey = source_id),
u AS (SELECT canonical_id, normalized, min((position, text)) AS f, count(*) AS n FROM o GROUP BY 1, 2)
SELECT u.canonical_id, normalized, f[1] AS position, f[2] AS text, n AS selected, CASE WHEN u.canonical_id % 20 = 0 THEN 'NEEDS_REVIEW' ELSE c.answer_status END AS answer_status FROM u JOIN c ON c.id = u.canonical_id""".replace("f[1]", "struct_extract_at(f, 1)").replace("f[2]", "struct_extract_at(f, 2)"))
def merged_canonicals(spark, folder):
    canonicals = adapters.canonical_rows(spark, folder)
    merges = canonicals.where("id % 10 = 1").select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("target_id"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    options = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("canonical_id"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", F.lit(" "), (F.col("l_suppkey") % 2).cast("string")).alias("text"),
        F.lower("l_returnflag").alias("normalized"), none.alias("correct"), none.alias("incorrect"), one.alias("selected"),
    )
    union = store.merged_options(store.merged_ids(options, merges)).select("canonical_id", "normalized", "position", "text", "selected")
    left = store.merge_canonicals(canonicals, merges, canonicals.where("id % 20 = 0").select("id")).select(F.col("id").alias("canonical_id"), "answer_status")
    return union.join(left, "canonical_id")


@query(f"""WITH {_C}, p AS (SELECT id, CASE WHEN p_size > 40 THEN ' new ' ELSE ' ' END AS s, p_size % 3 = 0 AS approve, CASE WHEN p_size % 5 = 0 THEN false END AS b FROM c WHERE p_size > 30)
SELECT c.id, CASE WHEN trim(p.s) <> '' THEN trim(p.s) ELSE c.stem END AS stem, CASE WHEN p.id IS NULL THEN key WHEN c.p_size % 4 = 0 THEN key ELSE 'D' END AS keys,
 CASE WHEN p.approve THEN 'MANUALLY_CONFIRMED' ELSE c.answer_status END AS answer_status, CASE WHEN c.id % 17 = 0 THEN 'REJECTED' WHEN p.approve THEN 'APPROVED' ELSE 'PENDING' END AS review_status,
 CASE WHEN p.approve THEN 1.0::DOUBLE ELSE c.confidence END AS confidence, coalesce(p.b, CASE WHEN p.approve THEN true ELSE c.in_bank END) AND c.id % 17 <> 0 AS in_bank
FROM c LEFT JOIN p USING (id)""")
def manual_updates(spark, folder):
    rows = adapters.canonical_rows(spark, folder)
    size = F.round(F.col("confidence") * 50).cast("int")
    patches = rows.where(size > 30).select(
        "id", F.when(size > 40, " new ").otherwise(" ").alias("stem"), F.when(size % 4 > 0, F.split(F.lit("D,X"), ",")).alias("keys"), (size % 3 == 0).alias("approve"), F.when(size % 5 == 0, False).alias("in_bank")
    )
    out = store.reject(store.update_manual(rows, patches), rows.where("id % 17 = 0").select("id"))
    return out.select("id", "stem", F.array_join("keys", ",").alias("keys"), "answer_status", "review_status", "confidence", "in_bank")


@query(f"""WITH {_T}, x AS (SELECT *, CASE WHEN task_id % 6 = 0 THEN 'dismiss' WHEN task_id % 6 = 1 THEN 'merge' END AS action FROM t),
y AS (SELECT *, CASE WHEN action = 'dismiss' THEN 'DISMISSED' WHEN action IS NOT NULL THEN 'RESOLVED' ELSE status END AS now FROM x)
SELECT task_id, action AS resolution, CASE WHEN canonical_id < 50 AND now = 'OPEN' AND kind <> 'POSSIBLE_DUPLICATE' THEN 'RESOLVED' ELSE now END AS status FROM y""")
def resolved_tasks(spark, folder):
    tasks = adapters.task_rows(spark, folder)
    decisions = tasks.where("task_id % 6 < 2").select("task_id", F.when(F.col("task_id") % 6 == 0, "dismiss").otherwise("merge").alias("action"))
    done = store.resolve_tasks(tasks, decisions)
    return store.close_tasks(done, tasks.where("canonical_id < 50")).select("task_id", "resolution", "status")


@query("""SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS questions, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey <> 4 GROUP BY 1, 2""")
def registered_documents(spark, folder):
    documents = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    status = F.when(F.col("o_orderstatus") == "P", "missing_answer").otherwise("answered")
    questions = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), status.alias("status"))
    left, kept = store.without_documents(documents, questions, documents.where("c_nationkey = 4"))
    return store.register_documents(left.drop("c_nationkey"), kept)


@query("""SELECT o_orderkey AS job_id, CASE WHEN ok THEN t ELSE s END AS state, ok AS moved FROM (SELECT *, coalesce((s = 'uploaded' AND t = 'processing') OR (s = 'processing' AND t IN ('completed', 'failed')) OR (s = 'failed' AND t = 'processing'), false) AS ok
 FROM (SELECT o_orderkey, ['uploaded', 'processing', 'failed', 'completed'][(o_orderkey % 4 + 1)::INT] AS s, CASE WHEN o_orderkey % 7 > 0 THEN ['processing', 'completed', 'failed'][(o_orderkey % 3 + 1)::INT] END AS t FROM orders))""")
def job_states(spark, folder):
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders")
    jobs = rows.select(key.alias("job_id"), adapters._one_of(key, "uploaded", "processing", "failed", "completed").alias("state"))
    events = rows.where("o_orderkey % 7 > 0").select(key.alias("job_id"), adapters._one_of(key, "processing", "completed", "failed").alias("to"))
    return store.job_states(jobs, events)


@query(f"WITH {_C} SELECT id AS canonical_id, CASE WHEN id % 2 = 0 THEN 'CONFIRMED' ELSE 'DOUBTFUL' END AS verdict, confidence, key AS suggested_keys, 1 AS round FROM c UNION ALL SELECT id, 'CONFIRMED', 0.9::DOUBLE, key, 2 FROM c WHERE in_bank")
def stored_verifications(spark, folder):
    rows = adapters.canonical_rows(spark, folder)
    old = rows.select(F.col("id").alias("canonical_id"), F.when(F.col("id") % 2 == 0, "CONFIRMED").otherwise("DOUBTFUL").alias("verdict"), "confidence", F.array_join("keys", ",").alias("suggested_keys"), F.lit(1).alias("created_at"))
    new = rows.where("in_bank").select(F.col("id").alias("canonical_id"), F.lit("CONFIRMED").alias("verdict"), F.lit(0.9).alias("confidence"), F.array_join("keys", ",").alias("suggested_keys"))
    return store.verifications(old, new, F.lit(2)).withColumnRenamed("created_at", "round")
