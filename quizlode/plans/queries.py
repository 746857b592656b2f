"""Every operator as a query over the star-schema tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, similarity, text
from ..operators import bank, engine, evidence, exam, export, geometry, layout, lookup, quiz, records, resolve
from ..sources import adapters, csv_bank, table, work_folder
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


# --- the exam parser -------------------------------------------------------------------------------------------------

_EXAM = """
SELECT n_regionkey AS document_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS number,
       'Region of ' || n_name || '?' AS question, {options}, {answer} AS answer, '{confidence}' AS confidence, '{status}' AS status
FROM nation
"""
_OPTIONS = ", ".join(f"(SELECT r_name FROM region WHERE r_regionkey = {i}) AS option_{c}" for i, c in enumerate("abcde"))
_ANSWERED = _EXAM.format(options=_OPTIONS, answer="substr('ABCDE', n_regionkey + 1, 1)", confidence="high", status="answered")


def _parsed(spark: SparkSession, folder: str, style: str) -> DataFrame:
    found = exam.parse_exam(adapters.exam_pages(spark, folder, style))
    options = [F.try_element_at("options", F.lit(c)).alias(f"option_{c.lower()}") for c in "ABCDE"]
    return found.select("document_id", "number", "question", *options, "answer", "confidence", "status")


@query(_ANSWERED)
def parse_rendered_exam(spark, folder):
    return _parsed(spark, folder, "inline")


@query(_ANSWERED)
def parse_exam_with_key(spark, folder):
    return _parsed(spark, folder, "key")


@query(_ANSWERED)
def parse_bengali_exam(spark, folder):
    return _parsed(spark, folder, "bengali")


@query(_EXAM.format(options=_OPTIONS, answer="NULL::VARCHAR", confidence="needs-review", status="missing_answer"))
def parse_exam_without_answers(spark, folder):
    return _parsed(spark, folder, "none")


@query("""SELECT n_regionkey AS document_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS number,
          substr('ABCDE', n_regionkey + 1, 1) AS answer FROM nation""")
def parse_answer_key_section(spark, folder):
    return exam.answer_keys(adapters.exam_pages(spark, folder, "key"))


# --- lines and text --------------------------------------------------------------------------------------------------

_LINES = "l AS (SELECT source AS document, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_NOISE = " OR ".join(f"regexp_matches(s, '(?i){p}')" for p in rules.NOISE_LINES)


@query(rf"""WITH {_LINES}, s AS (SELECT document, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l)
SELECT document, count(*) AS lines, count(*) FILTER (WHERE s <> '' AND ({_NOISE})) AS noise FROM s GROUP BY document""")
def noise_lines(spark, folder):
    rows = adapters.doc_lines(spark, folder)
    return rows.groupBy("document").agg(F.count("*").alias("lines"), F.count_if(text.is_noise_line(F.col("line"))).alias("noise"))


@query(rf"""WITH {_LINES}, m AS (SELECT *, max(pos) OVER (PARTITION BY document, page) AS last FROM l),
k AS (SELECT DISTINCT document, page, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM m WHERE pos = 0 OR pos = last),
n AS (SELECT document, count(DISTINCT page) AS n FROM l GROUP BY document),
c AS (SELECT document, key, count(*) AS pages FROM k WHERE key <> '' GROUP BY document, key)
SELECT document, key, pages FROM c JOIN n USING (document) WHERE n >= 3 AND pages >= greatest(3, least(ceil(n * 0.3), 6))""")
def running_noise_keys(spark, folder):
    return layout.running_noise(adapters.doc_lines(spark, folder))


_KEY = r"trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def normalize_dedupe_key(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("key"))


_COMPARE = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.,/#!$%^&*;:{}=\-_`~()?\"''\[\]\\|<>@+“”‘’।॥]', '', 'g'), '\s+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {_COMPARE} AS key FROM documents")
def normalize_for_comparison(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.comparison_key(F.col("text")).alias("key"))


@query("""SELECT DISTINCT l_linenumber AS n, CASE WHEN l_linenumber BETWEEN 1 AND 5 THEN substr('ABCDE', l_linenumber, 1) ELSE l_linenumber::VARCHAR END AS by_number,
          CASE WHEN l_returnflag = 'A' THEN 'A' ELSE lower(l_returnflag) END AS by_letter FROM lineitem""")
def normalize_option_key(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_linenumber", "l_returnflag").distinct()
    number = text.option_key(F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")")))
    letter = text.option_key(F.concat(F.lower("l_returnflag"), F.lit(".")))
    return rows.select(F.col("l_linenumber").alias("n"), number.alias("by_number"), letter.alias("by_letter"))


@query("SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯') AS bengali, o_orderkey::VARCHAR AS plain, true AS is_bengali FROM orders")
def bengali_digits(spark, folder):
    shown = text.digits_to_bengali(F.col("o_orderkey").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", shown.alias("bengali"), text.bengali_to_digits(shown).alias("plain"), text.has_bengali(shown).alias("is_bengali"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN c / t > 0.1 THEN CASE WHEN regexp_matches(text, '[іїєґІЇЄҐ]') THEN 'uk' ELSE 'ru' END END,
 CASE WHEN a / t > 0.1 THEN 'en' END, CASE WHEN b / t > 0.1 THEN 'bn' END], lambda x: x IS NOT NULL), ',') AS languages
FROM (SELECT *, greatest(a + b + c, 1) AS t FROM (SELECT doc_id, text, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a,
 length(regexp_replace(text, '[^ঀ-৿]', '', 'g')) AS b FROM documents))""")
def language_profile(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(text.languages(F.col("text")), ",").alias("languages"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS plain FROM pages""")
def web_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.strip_markup(F.col("html")).alias("plain"))


@query("""SELECT p_partkey, '10^{-' || p_size || '} \\mu m \\le ' || p_size AS latex, NULL::VARCHAR AS none FROM part""".replace("\\\\", "\\"))
def latex_render(spark, folder):
    raised = F.translate(F.col("p_size").cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    formula = F.concat(F.lit("10⁻"), raised, F.lit(" μm ≤"), F.col("p_size").cast("string"))
    return table(spark, folder, "part").select("p_partkey", text.to_latex(formula).alias("latex"), text.to_latex(F.col("p_name")).alias("none"))


@query("""SELECT o_orderkey, o_totalprice AS price FROM orders""")
def locale_numbers(spark, folder):
    shown = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    return table(spark, folder, "orders").select("o_orderkey", text.locale_number(shown).alias("price"))


@query(rf"""WITH d AS (SELECT doc_id, ' ' || {_KEY} || ' ' AS key, string_split({_KEY}, ' ') AS w FROM documents), i AS (SELECT item_id, {_KEY} AS phrase FROM benchmark),
u AS (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM d), h AS (SELECT DISTINCT doc_id, w[p] || ' ' || w[p + 1] AS pair FROM u),
k AS (SELECT item_id, phrase, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS pair FROM i WHERE contains(phrase, ' '))
SELECT item_id, sum((length(key) - length(replace(key, ' ' || phrase || ' ', '  '))) // length(phrase))::BIGINT AS n FROM h JOIN k USING (pair) JOIN d USING (doc_id) GROUP BY item_id HAVING n > 0""")
def phrase_counts(spark, folder):
    phrases = table(spark, folder, "benchmark").select("item_id", text.dedupe_key(F.col("text")).alias("phrase"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), text.dedupe_key(F.col("text")).alias("key"))
    return lookup.phrase_places(docs, phrases).groupBy("item_id").agg(F.sum("n").alias("n"))


# --- likeness --------------------------------------------------------------------------------------------------------

_STEMS = f"s AS (SELECT id, stem, {_KEY.replace('text', 'stem')} AS key, [lang, source] AS options FROM (SELECT min(doc_id) AS id, text AS stem, lang, source FROM documents GROUP BY text, lang, source))"
_ALL_STEMS = f"s AS (SELECT doc_id AS id, {_KEY} AS key FROM documents)"
_BLOCKS = r"""t AS (SELECT id, key, list_distinct(list_filter(string_split(key, ' '), lambda t: length(t) >= 4)) AS ts FROM s),
u AS (SELECT id, unnest(ts) AS tok, key FROM t), o AS (SELECT id, tok, length(tok) AS n, instr(' ' || key || ' ', ' ' || tok || ' ') AS p FROM u),
b AS (SELECT id, tok AS block FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS r FROM o) WHERE r <= 4
      UNION ALL SELECT id, substr(key, 1, 12) FROM t WHERE len(ts) = 0)"""


@query(f"WITH {_ALL_STEMS}, {_BLOCKS} SELECT id, block FROM b")
def blocking_keys(spark, folder):
    return adapters.stems(spark, folder).select("id", F.explode(similarity.blocking_keys(F.col("key"))).alias("block"))


_MATCHES = f"""WITH {_STEMS}, {_BLOCKS},
p AS (SELECT DISTINCT x.id AS a_id, y.id AS b_id FROM b x JOIN b y USING (block) WHERE x.id < y.id),
g AS (SELECT id, stem, key, options, list_distinct(list_transform(list_zip(c[:-3], c[2:-2], c[3:]), lambda x: x[1] || x[2] || x[3])) AS g FROM (SELECT *, string_split(' ' || key || ' ', '') AS c FROM s)),
c AS (SELECT a_id, b_id, x.stem = y.stem AND x.stem <> '' AS same, x.key = y.key AND x.key <> '' AS alike,
      len(list_intersect(x.options, y.options)) AS oi, len(list_distinct(x.options)) + len(list_distinct(y.options)) AS os,
      len(list_intersect(x.g, y.g)) AS gi, len(x.g) + len(y.g) AS gs
      FROM p JOIN g x ON x.id = a_id JOIN g y ON y.id = b_id),
e AS (SELECT a_id, b_id, same, alike, oi::DOUBLE / (os - oi) AS option_score, CASE WHEN same OR alike THEN 1.0::DOUBLE WHEN gs = 0 THEN 1.0::DOUBLE ELSE gi::DOUBLE / (gs - gi) END AS stem_score FROM c),
f AS (SELECT *, (CASE WHEN same THEN 1 WHEN alike THEN 2 WHEN stem_score >= 0.9 AND option_score >= 0.9 THEN 3 WHEN stem_score >= 0.8 AND option_score >= 0.99 THEN 4
      WHEN stem_score >= 0.75 AND option_score >= 0.6 THEN 5 WHEN stem_score >= 0.6 THEN 6 END)::INTEGER AS level FROM e),
m AS (SELECT a_id, b_id, level, CASE level WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.98::DOUBLE ELSE 0.65::DOUBLE * stem_score + 0.35::DOUBLE * option_score END AS score, stem_score, option_score,
      CASE WHEN level <= 2 THEN option_score >= 0.75 ELSE level <= 4 END AS auto_merge FROM f WHERE level IS NOT NULL)"""


@query(f"{_MATCHES} SELECT * FROM m")
def candidate_matches(spark, folder):
    return resolve.distinct_matches(adapters.stems(spark, folder))


@query(f"{_MATCHES} SELECT a_id, b_id, level, score, auto_merge FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS r FROM m) WHERE r = 1")
def best_matches(spark, folder):
    return resolve.best_match(resolve.distinct_matches(adapters.stems(spark, folder)))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text, lang, source) AS of FROM documents")
def folded_stems(spark, folder):
    return resolve.folded(adapters.stems(spark, folder))[1]


@query("""WITH h AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)
SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.bits[i] - b.bits[i])))::INTEGER AS distance
FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def hash_hamming_pairs(spark, folder):
    rows = table(spark, folder, "embeddings")
    bit = lambda i: F.when(F.get("embedding", i) > 0, F.lit("1")).otherwise(F.lit("0"))
    nibble = lambda j: F.lower(F.conv(F.concat(*[bit(j * 4 + k) for k in range(4)]), 2, 16))
    hashes = rows.select("vec_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), nibble), "").alias("hash"))
    other = hashes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b_id"), F.col("hash").alias("b_hash"))
    return hashes.join(other, "vec_id").select(F.col("vec_id").alias("a_id"), "b_id", similarity.hamming(F.col("hash"), F.col("b_hash")).alias("distance"))


# --- the bank --------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT doc_id AS id, {_COMPARE} AS key FROM documents)
SELECT id, first, size FROM (SELECT id, min(id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS size FROM k WHERE key <> '') WHERE size > 1""")
def duplicate_groups(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    return bank.duplicate_groups(docs, text.comparison_key(F.col("text")))


@query(f"""WITH r AS (SELECT doc_id AS id, {_KEY} AS key, doc_id IN (SELECT doc_id FROM labels) AS has FROM documents)
SELECT id, first, attempts FROM (SELECT id, min(id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS attempts,
 row_number() OVER (PARTITION BY key ORDER BY has DESC, id) AS k FROM r) WHERE k = 1""")
def dedupe_keep_answered(spark, folder):
    marked = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("has")).distinct()
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(1).cast("long").alias("attempts")).join(marked, "id", "left")
    return bank.dedupe(rows, text.dedupe_key(F.col("text")), F.coalesce("has", F.lit(False))).select("id", F.col("_first").alias("first"), "attempts")




@query("""WITH b AS (SELECT c_custkey % 1000 AS key, max(CASE WHEN c_nationkey < 6 THEN c_mktsegment END) AS answer FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
i AS (SELECT c_custkey % 1200 AS key, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_nationkey < 20) AS answer FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT coalesce(b.key, i.key) AS key, coalesce(b.answer, i.answer) AS answer,
 CASE WHEN b.key IS NULL THEN 'added' WHEN b.answer IS NULL AND i.answer IS NOT NULL THEN 'filled' ELSE 'kept' END AS change FROM b FULL JOIN i ON b.key = i.key""")
def merge_into_bank(spark, folder):
    rows = table(spark, folder, "customer")
    old = rows.where("c_custkey % 3 <> 0").groupBy((F.col("c_custkey") % 1000).alias("key")).agg(F.max(F.when(F.col("c_nationkey") < 6, F.col("c_mktsegment"))).alias("answer"))
    new = rows.where("c_custkey % 3 = 0").select((F.col("c_custkey") % 1200).alias("key"), F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("answer"))
    return bank.merge_into(old, new)


_BANK = """b AS (SELECT p_partkey AS id, p_name AS question, p_brand AS category, p_type AS document, CASE WHEN p_size % 3 = 0 THEN NULL ELSE substr('ABCD', p_size % 4 + 1, 1) END AS answer,
 CASE p_size % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'review' ELSE 'pending' END AS status,
 CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'needs-review' END AS confidence, p_retailprice AS score, p_size AS size FROM part)"""


@query(f"""WITH {_BANK} SELECT id, question, status, score FROM b WHERE (contains(lower(question), 'a') OR contains(lower(category), 'a') OR contains(lower(document), 'a') OR answer = 'A')
AND status = 'verified' ORDER BY score DESC, id LIMIT 20 OFFSET 20""")
def bank_search_filter_page(spark, folder):
    found = bank.search(adapters.bank(spark, folder), "a", status="approved")
    return bank.page(found, [F.desc("score"), F.asc("id")], 2, 20).select("id", "question", "status", "score")


@query(f"WITH {_BANK} SELECT id FROM b WHERE answer IS NULL AND confidence = 'high'")
def bank_review_filter(spark, folder):
    return bank.search(adapters.bank(spark, folder), status="review", confidence="high").select("id")


@query(f"WITH {_BANK} SELECT status, count(*) AS n FROM b GROUP BY status")
def status_facets(spark, folder):
    return bank.facet(adapters.bank(spark, folder), "status")


@query(f"""WITH {_BANK} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'pending') AS pending,
 count(*) FILTER (WHERE status NOT IN ('verified', 'pending') AND (status = 'review' OR confidence = 'needs-review')) AS review,
 count(answer) AS answered, count(DISTINCT category) AS categories FROM b""")
def bank_stats(spark, folder):
    return bank.stats(adapters.bank(spark, folder))


@query("""SELECT e.event_id AS task_id, o.o_orderstatus AS stem, c.c_name AS filename FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 300) e
LEFT JOIN orders o ON o.o_orderkey = e.event_id LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def review_tasks_joined(spark, folder):
    tasks = table(spark, folder, "events").select(F.col("event_id").alias("task_id"), F.col("event_id").alias("canonical_id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("kind"), F.lit("OPEN").alias("status"))
    canonicals = table(spark, folder, "orders").select(F.col("o_orderkey").alias("canonical_id"), F.col("o_orderstatus").alias("stem"))
    documents = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    return bank.review_tasks(tasks, canonicals, documents, kind="error").select("task_id", "stem", "filename")


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def open_tasks_by_kind(spark, folder):
    return bank.facet(table(spark, folder, "events").where("value > 10").withColumnRenamed("event_type", "kind"), "kind")


@query("""SELECT user_id, kind, event_id, value FROM (SELECT user_id, event_type AS kind, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_pages_last_wins(spark, folder):
    rows = table(spark, folder, "events").select("user_id", F.col("event_type").alias("kind"), "event_id", "value")
    return bank.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "kind"], "event_id")


@query("""WITH o AS (SELECT p_partkey AS id, p_size > 40 AS is_manual, p_name AS stem, p_brand AS answer FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS id, p_name || '!' AS stem, p_type AS answer FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.is_manual, false) AS is_manual, CASE WHEN n.id IS NULL THEN o.stem ELSE n.stem END AS stem,
 CASE WHEN n.id IS NULL OR coalesce(o.is_manual, false) THEN o.answer ELSE n.answer END AS answer FROM o FULL JOIN n ON o.id = n.id""")
def write_canonical_manual_lock(spark, folder):
    part = table(spark, folder, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 40).alias("is_manual"), F.col("p_name").alias("stem"), F.col("p_brand").alias("answer"))
    new = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("!")).alias("stem"), F.col("p_type").alias("answer"))
    return bank.write_canonicals(old, new, ["answer"])


@query(f"WITH {_BANK} SELECT id, CASE WHEN size > 45 THEN 'verified' ELSE status END AS status FROM b WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def approve_and_delete(spark, folder):
    rows = adapters.bank(spark, folder)
    approved = bank.approve(rows, rows.where("size > 45").select("id"))
    return bank.delete(approved, rows.where("size = 1").select("id")).select("id", "status")


# --- evidence and resolution -----------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 50) < 1e-6 THEN 'FULL_SCORE' WHEN abs(l_quantity - 1) < 1e-6 THEN 'ZERO_SCORE'
 WHEN l_quantity < 1 THEN 'NEGATIVE_SCORE' ELSE 'PARTIAL_SCORE' END AS kind FROM lineitem""")
def score_kind(spark, folder):
    kind = evidence.score_kind(F.col("l_quantity") - 1, F.lit(49.0))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"))


_MARKS = """SELECT DISTINCT l_orderkey % 100 AS document_id, l_orderkey AS question_id, (l_suppkey % 3)::VARCHAR AS glyph,
 CASE l_returnflag WHEN 'A' THEN 'FULL_SCORE' WHEN 'N' THEN 'PARTIAL_SCORE' ELSE 'ZERO_SCORE' END AS score_kind FROM lineitem"""


@query(f"""WITH m AS ({_MARKS}), s AS (SELECT document_id, glyph, count(*) AS n, avg((score_kind = 'FULL_SCORE')::INT) AS share FROM m WHERE score_kind <> 'PARTIAL_SCORE' GROUP BY 1, 2)
SELECT *, CASE WHEN n >= 2 THEN CASE WHEN share >= 0.85 THEN 'CHECKMARK' WHEN share <= 0.15 THEN 'CROSS' END END AS meaning FROM s""")
def glyph_meanings(spark, folder):
    rows = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "FULL_SCORE").when(F.col("l_returnflag") == "N", "PARTIAL_SCORE").otherwise("ZERO_SCORE")
    return evidence.glyph_meanings(rows.select((F.col("l_orderkey") % 100).alias("document_id"), F.col("l_orderkey").alias("question_id"), (F.col("l_suppkey") % 3).cast("string").alias("glyph"), kind.alias("score_kind")))


_VOTES = """v AS (SELECT l_partkey AS canonical_id, (l_suppkey % 4)::INT AS option, l_returnflag = 'A' AS correct, l_returnflag = 'R' AS incorrect, l_linestatus = 'O' AS multi FROM lineitem),
o AS (SELECT canonical_id, option, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE incorrect) AS incorrect, count(*) AS selected FROM v GROUP BY 1, 2)"""


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.instances(spark, folder)
    return rows.select("canonical_id", F.col("picked").alias("option"), (F.col("score_kind") == "FULL_SCORE").alias("correct"), (F.col("score_kind") == "ZERO_SCORE").alias("incorrect"), "multi")


@query(f"WITH {_VOTES} SELECT * FROM o")
def option_votes(spark, folder):
    return resolve.option_votes(_votes(spark, folder))


_SETS = "c AS (SELECT canonical_id, count(*) AS n_complete, count(DISTINCT option) AS n_sets FROM v WHERE correct AND NOT multi GROUP BY 1)"


@query(f"WITH {_VOTES}, {_SETS} SELECT * FROM c")
def complete_set_conflicts(spark, folder):
    members = _votes(spark, folder).where("correct AND NOT multi")
    return resolve.complete_sets(members.select("canonical_id", F.array(F.col("option").cast("string")).alias("keys")))


@query(f"""WITH {_VOTES}, {_SETS}, m AS (SELECT canonical_id, count(*) AS n_members, bool_or(multi) AS multi FROM v GROUP BY 1),
k AS (SELECT canonical_id, count(*) AS n, bool_or(correct > 0 AND incorrect > 0) AS clash, count(*) FILTER (WHERE correct > 0 AND incorrect = 0) AS sure,
 count(*) FILTER (WHERE incorrect = 0) AS rest, count(*) FILTER (WHERE correct = 0 AND incorrect = 0) AS open,
 string_agg(option::VARCHAR, ',' ORDER BY option) FILTER (WHERE correct > 0 AND incorrect = 0) AS ks, string_agg(option::VARCHAR, ',' ORDER BY option) FILTER (WHERE incorrect = 0) AS kr FROM o GROUP BY 1),
j AS (SELECT *, coalesce(n_complete, 0) AS nc, coalesce(n_sets, 0) AS ns, clash OR coalesce(n_sets, 0) > 1 AS conflict, NOT multi AND n >= 2 AS single FROM k JOIN m USING (canonical_id) LEFT JOIN c USING (canonical_id)),
s AS (SELECT *, single AND sure <> 1 AND rest = 1 AND n >= 3 AND n_members >= 2 AS lone FROM j)
SELECT canonical_id,
 CASE WHEN conflict THEN 'CONFLICT' WHEN nc > 0 THEN CASE WHEN nc >= 2 OR (n_members >= 2 AND sure > 0) THEN 'CONFIRMED_BY_MULTIPLE_ATTEMPTS' ELSE 'CONFIRMED_BY_SCORE' END
  WHEN single AND sure = 1 THEN CASE WHEN n_members >= 2 THEN 'CONFIRMED_BY_MULTIPLE_ATTEMPTS' ELSE 'NEEDS_REVIEW' END WHEN lone THEN 'CONFIRMED_BY_MULTIPLE_ATTEMPTS'
  WHEN single THEN CASE WHEN sure > 0 THEN 'NEEDS_REVIEW' ELSE 'UNRESOLVED' END
  WHEN sure > 0 THEN CASE WHEN open = 0 AND n_members >= 2 THEN 'CONFIRMED_BY_MULTIPLE_ATTEMPTS' ELSE 'NEEDS_REVIEW' END ELSE 'UNRESOLVED' END AS answer_status,
 round((CASE WHEN conflict THEN 0.3 WHEN nc > 0 THEN least(0.99, 0.93 + 0.02 * (nc - 1)) WHEN single AND sure = 1 THEN CASE WHEN n_members >= 2 THEN 0.85 ELSE 0.7 END WHEN lone THEN 0.75
  WHEN single THEN CASE WHEN sure > 0 THEN 0.5 ELSE 0.0 END WHEN sure > 0 THEN CASE WHEN open = 0 AND n_members >= 2 THEN 0.8 ELSE 0.5 END ELSE 0.0 END)::DOUBLE, 2) AS confidence,
 coalesce(CASE WHEN lone THEN kr ELSE ks END, '') AS correct_keys FROM s""")
def canonical_status(spark, folder):
    votes = _votes(spark, folder)
    options = resolve.option_votes(votes).groupBy("canonical_id").agg(F.collect_list(F.struct("option", "correct", "incorrect")).alias("options"))
    members = votes.groupBy("canonical_id").agg(F.count("*").alias("n_members"), F.bool_or("multi").alias("multi"))
    sets = resolve.complete_sets(votes.where("correct AND NOT multi").select("canonical_id", F.array(F.col("option").cast("string")).alias("keys")))
    both = options.join(members, "canonical_id").join(sets, "canonical_id", "left").na.fill(0, ["n_complete", "n_sets"])
    return resolve.resolve(both.withColumn("by_document", F.lit(False)).withColumn("best", F.lit(0.93)))


@query("SELECT l_orderkey AS attempt_id, count(*) AS question_count, min(l_linenumber) AS first_page, max(l_linenumber) AS end_page FROM lineitem GROUP BY 1")
def attempt_rollup(spark, folder):
    return evidence.attempts(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("page")))


@query("""SELECT document_id, sequence, previous, number - previous AS gap, number - previous <= 0 AS restarts FROM (SELECT o_custkey AS document_id, o_orderkey AS sequence, o_orderkey % 7 AS number,
 lag(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE number - previous > 1 OR number - previous <= 0""")
def number_gaps(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("sequence"), (F.col("o_orderkey") % 7).alias("number"))
    return layout.number_gaps(rows)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n FROM lineitem WHERE l_quantity > 5)
SELECT e.d AS document_id, count(*) AS expected, count(f.d) AS found, count(*) - count(f.d) AS missing, count(*) = count(f.d) AS balanced FROM e LEFT JOIN f ON e.d = f.d AND e.n = f.n GROUP BY 1""")
def coverage_audit(spark, folder):
    rows = table(spark, folder, "lineitem")
    pick = lambda d: d.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("number"))
    return layout.coverage(pick(rows.where("l_quantity > 5")), pick(rows))


_COUNTS = "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS h, count(*) FILTER (WHERE event_type = 'click') AS s, count(*) FILTER (WHERE event_type = 'signup') AS m, count(*) FILTER (WHERE event_type = 'error') AS g, count(*) AS p, count(*) FILTER (WHERE value > 80) AS o FROM events GROUP BY 1"


@query(f"""SELECT user_id, CASE WHEN o > 0.6 * p THEN 'SCANNED' WHEN h > 0 AND s > 0 AND m > 0 THEN 'MOODLE_EXPORT' WHEN h > 0 AND s > 0 THEN 'LMS_EXPORT' WHEN g >= 4 THEN 'PLUS_MINUS_BANK'
 WHEN h >= 2 THEN 'NUMBERED_LIST' ELSE 'UNKNOWN' END AS source_type FROM ({_COUNTS})""")
def source_type_decision(spark, folder):
    kinds = {"h": "view", "s": "click", "m": "signup", "g": "error"}
    counts = table(spark, folder, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()], F.count("*").alias("p"), F.count_if(F.col("value") > 80).alias("o"))
    return counts.select("user_id", layout.source_type(*[F.col(c) for c in "hsmgpo"]).alias("source_type"))


_TYPE_FEATURES = """f AS (SELECT p_partkey AS id, p_size % 4 AS n, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS multi, CASE p_size % 7 WHEN 0 THEN 'MATCHING' WHEN 1 THEN 'ORDERING' WHEN 2 THEN 'TEXT' END AS kind,
 CASE p_size % 5 WHEN 0 THEN 'Match the pairs' WHEN 1 THEN 'Put in correct order' WHEN 2 THEN 'Shown in the figure' WHEN 3 THEN 'Calculate the mass' ELSE 'Which one?' END AS stem,
 p_size % 3 AS codes, p_size % 4 AS pairs, p_size % 3 AS checks, p_size % 2 AS plus, p_size % 5 AS selected, p_size % 2 = 0 AS img, p_size % 11 = 0 AS tab, p_size % 13 = 0 AS formula, CASE p_size % 6 WHEN 0 THEN '12 kg' WHEN 1 THEN 'text' END AS feedback FROM part)"""
_TYPE_CUES = (
    ("MATCHING", 4, "kind = 'MATCHING'"), ("ORDERING", 4, "kind = 'ORDERING'"), ("SHORT_TEXT", 2, "kind = 'TEXT' AND n = 0"), ("SINGLE_CHOICE", 2, "kind = 'TEXT' AND n > 0"), ("MULTIPLE_CHOICE", 4, "multi"),
    ("SINGLE_CHOICE", 4, "NOT multi"), ("MATCHING", 3, "stem LIKE 'Match the%'"), ("ORDERING", 3, "stem LIKE '%correct order'"), ("IMAGE_IDENTIFICATION", 3, "stem LIKE 'Shown in%' AND img"),
    ("IMAGE_IDENTIFICATION", 1.5, "stem LIKE 'Shown in%' AND NOT img"), ("ORDERING", 1.5, "codes >= 2"), ("MATCHING", 1, "codes >= 2"), ("MATCHING", 3, "pairs >= 2"), ("TRUE_FALSE", 5, "n = 2"), ("SINGLE_CHOICE", 1, "n >= 2"),
    ("MULTIPLE_CHOICE", 3, "n >= 2 AND greatest(checks, plus) >= 2"), ("MULTIPLE_CHOICE", 2, "n >= 2 AND selected >= 2"), ("SINGLE_CHOICE", 1, "n >= 2 AND greatest(checks, plus) = 1 AND multi IS NOT TRUE"),
    ("NUMERIC", 3, "n = 0 AND stem LIKE 'Calculate%'"), ("NUMERIC", 2, "n = 0 AND feedback = '12 kg'"), ("FORMULA", 2, "n = 0 AND formula"), ("TABLE", 2, "n = 0 AND tab"), ("SHORT_TEXT", 2, "n = 0 AND feedback IS NOT NULL"),
    ("SHORT_TEXT", 0.5, "n = 0 AND feedback IS NULL"), ("TABLE", 0.5, "tab AND n >= 2"),
)
_TYPE_ROWS = " UNION ALL ".join(f"SELECT id, {i} AS i, '{t}' AS t, {w}::DOUBLE AS w FROM f WHERE {c}" for i, (t, w, c) in enumerate(_TYPE_CUES))


@query(f"""WITH {_TYPE_FEATURES}, c AS ({_TYPE_ROWS}), s AS (SELECT id, t, sum(w) AS s, min(i) AS i FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS s2, lead(t) OVER w AS t2, sum(s) OVER (PARTITION BY id) AS total FROM s WINDOW w AS (PARTITION BY id ORDER BY s DESC, i)),
b AS (SELECT *, coalesce(s2 >= 3 AND s - s2 < 0.5 AND NOT (t IN ('SINGLE_CHOICE', 'MULTIPLE_CHOICE') AND t2 IN ('SINGLE_CHOICE', 'MULTIPLE_CHOICE')), false) AS mixed FROM r WHERE k = 1)
SELECT f.id, CASE WHEN t IS NULL THEN 'UNKNOWN' WHEN mixed THEN 'COMBINATION' ELSE t END AS type, CASE WHEN t IS NULL THEN 0.0::DOUBLE WHEN mixed THEN 0.55::DOUBLE
 ELSE round(greatest(0.3::DOUBLE, least(0.99::DOUBLE, 0.5::DOUBLE * (s / total) + 0.5::DOUBLE * coalesce((s - s2) / greatest(s, 1), 1) + CASE WHEN s >= 4 THEN 0.1::DOUBLE ELSE 0 END)), 2) END AS confidence
FROM f LEFT JOIN b USING (id)""")
def question_type_score(spark, folder):
    size = F.col("p_size")
    stems = ("Match the pairs", "Put in correct order", "Shown in the figure", "Calculate the mass", "Which one?")
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.get(F.array(*[F.lit(x) for x in stems]), size % 5).alias("stem"),
        F.when(size % 3 == 0, True).when(size % 3 == 1, False).alias("multi"), F.when(size % 7 == 0, "MATCHING").when(size % 7 == 1, "ORDERING").when(size % 7 == 2, "TEXT").alias("kind"),
        F.when(size % 4 == 2, F.split(F.lit("True,false"), ",")).otherwise(F.slice(F.split(F.lit("x,y,z"), ","), F.lit(1), size % 4)).alias("options"),
        (size % 3).alias("codes"), (size % 4).alias("pairs"), (size % 3).alias("checks"), (size % 2).alias("plus"), (size % 5).alias("selected"), (size % 2 == 0).alias("has_image"),
        (size % 11 == 0).alias("has_table"), (size % 13 == 0).alias("has_formula"), F.when(size % 6 == 0, "12 kg").when(size % 6 == 1, "text").alias("feedback"),
    )
    return layout.question_type(rows)


@query("""WITH g AS (SELECT o_custkey AS block, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders),
a AS (SELECT block, count(*) AS lines, min(gap) AS least, max(gap) AS most FROM g GROUP BY block) SELECT *, coalesce(most - least > 1 AND most > 1.25 * least, false) AS varied FROM a""")
def vertical_gaps(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("y"))
    return layout.vertical_gaps(rows)


#: Terms that tell subjects apart in the invented languages of the test tables.
_TERMS = (("north", "tion"), ("north", "heth"), ("south", "ment"), ("south", "eaux"), ("east", "keit"), ("east", "schaft"), ("west", "ción"), ("west", "esca"))
_TERMS_SQL = ", ".join(f"('{s}', '{t}')" for s, t in _TERMS)


@query(f"""WITH t AS (SELECT * FROM (VALUES {_TERMS_SQL}) AS t(subject, term)),
h AS (SELECT doc_id AS id, subject, sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS hits FROM documents JOIN t ON contains(lower(text), term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(hits) OVER w, 0) AS second FROM h WINDOW w AS (PARTITION BY id ORDER BY hits DESC, subject))
SELECT id, subject, hits, round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.6::DOUBLE * (hits - second) / hits), 6) AS confidence FROM r WHERE k = 1 AND hits >= 3""")
def subject_detection(spark, folder):
    terms = spark.sql(f"SELECT * FROM VALUES {_TERMS_SQL} AS t(subject, term)")
    return layout.subjects(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), terms)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN list_sort([l_quantity::INT % 3, l_linenumber % 3, l_suppkey::INT % 3]) = [0, 1, 2] THEN true ELSE false END AS ordered FROM lineitem""")
def order_codes(spark, folder):
    codes = F.array((F.col("l_quantity").cast("int") % 3), F.col("l_linenumber") % 3, (F.col("l_suppkey") % 3).cast("int"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", evidence.order_codes(codes).alias("ordered"))


@query("""WITH q AS (SELECT p_partkey AS id, (p_size % 4 + 2)::INT AS n, (1 + p_size % 3)::INT AS picked, (p_size % 5) / 4.0::DOUBLE AS grade FROM part),
m AS (SELECT id, n, picked, grade, unnest(range(1, (1 << n) - 1))::INT AS mask FROM q),
c AS (SELECT id, mask, abs(greatest(bit_count(mask & picked) / bit_count(mask)::DOUBLE - (bit_count(picked) - bit_count(mask & picked)) / (n - bit_count(mask))::DOUBLE, 0) - grade) <= 0.006 AS ok FROM m)
SELECT id, CASE WHEN count(*) FILTER (WHERE ok) = 1 THEN max(mask) FILTER (WHERE ok) END AS mask FROM c GROUP BY id""")
def solve_by_score(spark, folder):
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (size % 4 + 2).cast("int").alias("n"), (size % 3 + 1).cast("int").alias("picked"), ((size % 5) / 4.0).alias("grade"))
    return rows.select("id", evidence.solve_by_score(F.col("n"), F.col("picked"), F.col("grade")).alias("mask"))


# --- places ----------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_orderkey AS page, l_linenumber AS mark_id, l_quantity AS y, l_tax * 100 AS h FROM lineitem), o AS (SELECT l_orderkey AS page, l_partkey AS option_id, l_discount * 500 AS oy FROM lineitem),
b AS (SELECT page, mark_id, option_id, abs(y - oy) AS dy, h FROM m JOIN o USING (page)), k AS (SELECT page, mark_id, min((round(dy, 6), option_id)) AS best FROM b WHERE dy <= 1.2 * greatest(h, 8) GROUP BY 1, 2)
SELECT page * 10 + mark_id AS mark_id, best[2] AS option_id, best[1] AS dy FROM k""".replace("best[2]", "struct_extract_at(best, 2)").replace("best[1]", "struct_extract_at(best, 1)"))
def nearest_option_for_mark(spark, folder):
    rows = table(spark, folder, "lineitem")
    marks = rows.select(F.col("l_orderkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mark_id"), F.round("l_quantity", 6).alias("y"), (F.col("l_tax") * 100).alias("h"))
    options = rows.select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("option_id"), F.round(F.col("l_discount") * 500, 6).alias("oy"))
    return geometry.nearest(marks, options).withColumn("dy", F.round("dy", 6))


@query("""SELECT i.l_orderkey * 10 + i.l_linenumber AS image_id, b.l_orderkey * 10 + b.l_linenumber AS block_id FROM lineitem i JOIN lineitem b ON i.l_orderkey = b.l_orderkey
 AND i.l_quantity BETWEEN b.l_linenumber * 7 - 4 AND b.l_linenumber * 7 + 7 + 4""")
def image_range_join(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    images = rows.select(F.col("l_orderkey").alias("page"), F.col("id").alias("image_id"), F.col("l_quantity").alias("cy"))
    blocks = rows.select(F.col("l_orderkey").alias("page"), F.col("id").alias("block_id"), (F.col("l_linenumber") * 7).alias("top"), (F.col("l_linenumber") * 7 + 7).alias("bottom"))
    return geometry.within(images, blocks)


@query("""SELECT o.o_orderkey AS order_id, (SELECT max(e.event_id) FROM events e WHERE e.user_id = o.o_custkey AND e.event_id <= o.o_orderkey) AS owner FROM orders o""")
def asof_figure_owner(spark, folder):
    figures = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("order_id"))
    starts = table(spark, folder, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("at"), F.col("event_id").alias("owner"))
    return geometry.last_before(figures, starts, "doc", "at", "owner").select("order_id", "owner")


# --- lookups and quizzes ---------------------------------------------------------------------------------------------

_ROOTS = r"list_distinct(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 4), lambda w: substr(w, 1, 4)))"
_SENTENCES = r"""q AS (SELECT item_id AS question_id, """ + _ROOTS.format(x="text") + r""" AS r FROM benchmark),
x AS (SELECT doc_id AS source_id, regexp_split_to_array(text, '[.!?\n]+') AS a FROM documents), u AS (SELECT source_id, unnest(range(0, len(a))) AS pos, a FROM x),
t AS (SELECT source_id, pos::INTEGER AS pos, trim(a[pos + 1], ' ') AS sentence FROM u), s AS (SELECT source_id, pos, """ + _ROOTS.format(x="sentence") + r""" AS r FROM t WHERE length(sentence) > 15 AND length(sentence) < 1200),
a AS (SELECT question_id, len(r) AS n, unnest(r) AS root FROM q), b AS (SELECT source_id, pos, unnest(r) AS root FROM s),
e AS (SELECT question_id, source_id, pos, count(*) / any_value(n)::DOUBLE AS score FROM b JOIN a USING (root) GROUP BY 1, 2, 3)"""


@query(f"WITH {_SENTENCES} SELECT * FROM e WHERE score >= 0.5")
def sentence_evidence(spark, folder):
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return lookup.sentence_evidence(questions, table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("""WITH s AS (SELECT l_orderkey AS question_id, l_suppkey % 4 AS label, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, label DESC))
SELECT question_id, label AS winner, score FROM r WHERE k = 1 AND score >= 0.65 AND score - second >= 0.15""")
def pick_winner(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), (F.col("l_suppkey") % 4).alias("label")).agg((F.max("l_quantity") / 50).alias("score"))
    return lookup.pick_winner(rows, 0.65, 0.15)


@query("""WITH w AS (SELECT p_partkey AS id, regexp_replace(replace(lower(p_name), 'ё', 'е'), '[\\s\\-–—.,;:!?«»"''()]+', '', 'g') AS y,
 regexp_replace(replace(lower(CASE WHEN p_size % 2 = 0 THEN upper(p_name) WHEN p_size % 3 = 0 THEN substr(p_name, 2) ELSE reverse(p_name) END), 'ё', 'е'), '[\\s\\-–—.,;:!?«»"''()]+', '', 'g') AS x FROM part)
SELECT id, x <> '' AND (x = y OR levenshtein(x, y) <= length(y) // 6) AS is_right FROM w""".replace("\\\\", "\\"))
def quiz_text_match(spark, folder):
    rows = table(spark, folder, "part")
    typed = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 0, F.expr("substring(p_name, 2)")).otherwise(F.reverse("p_name"))
    return rows.select(F.col("p_partkey").alias("id"), quiz.text_matches(typed, F.col("p_name")).alias("is_right"))


@query("""WITH a AS (SELECT o_custkey AS student, CASE o_orderstatus WHEN 'F' THEN ['A', 'C'] ELSE ['B'] END AS picked, CASE WHEN o_orderkey % 3 = 0 THEN ['A', 'C'] ELSE ['B'] END AS want FROM orders)
SELECT student, count(*) AS n, count(*) FILTER (WHERE picked = want) AS "right", floor(100.0::DOUBLE * count(*) FILTER (WHERE picked = want) / count(*) + 0.5)::BIGINT AS percent FROM a GROUP BY student""")
def quiz_grade(spark, folder):
    rows = table(spark, folder, "orders")
    picked = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("C"), F.lit("A"))).otherwise(F.array(F.lit("B")))
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit("A, C")).otherwise(F.lit("B"))
    return quiz.grade(rows.select(F.col("o_custkey").alias("student"), quiz.choice_right(picked, key).alias("is_right")), "student")


# --- files -----------------------------------------------------------------------------------------------------------


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.bank(spark, folder)
    options = F.create_map(F.lit("A"), F.col("category"), F.lit("B"), F.col("document"), F.lit("C"), F.concat(F.lit('say "'), F.col("category"), F.lit('"')))
    return rows.select("id", F.col("id").cast("int").alias("number"), "question", options.alias("options"), "answer", "confidence", F.lit(1).alias("page"))


@query(f'''WITH {_BANK} SELECT id, '"' || question || '","' || category || '","' || document || '","say ""' || category || '""","","' || coalesce(answer, '') || '"' AS line FROM b''')
def standard_csv_rows(spark, folder):
    return export.csv_rows(_questions(spark, folder))


@query(f'''WITH {_BANK} SELECT id, id || '. ' || question || chr(10) || '   A. ' || category || chr(10) || '   B. ' || document || chr(10) || '   C. say "' || category || '"' || chr(10) ||
 CASE WHEN answer IS NULL THEN '   Answer: Not detected (Needs Review)' ELSE '   Answer: ' || answer || CASE answer WHEN 'A' THEN ' (' || category || ')' WHEN 'B' THEN ' (' || document || ')' WHEN 'C' THEN ' (say "' || category || '")' ELSE '' END END AS block FROM b''')
def export_text_block(spark, folder):
    return export.text_blocks(_questions(spark, folder))


@query(f'''WITH {_BANK} SELECT id, '{{"number":' || id || ',"question":"' || question || '","options":{{"A":"' || category || '","B":"' || document || '","C":"say \\"' || category || '\\""}},"correctAnswer":' ||
 CASE WHEN answer IS NULL THEN 'null' ELSE '"' || answer || '"' END || ',"confidence":"' || confidence || '","pageNumber":1}}' AS json FROM b''')
def export_json_rows(spark, folder):
    return export.json_rows(_questions(spark, folder))


@query(f'''WITH {_BANK} SELECT id, '"' || id || '","' || question || '","' || category || '","' || document || '","say ""' || category || '""","","","' || coalesce(answer, 'Not detected') || '","' || confidence || '","1"' AS line FROM b''')
def full_csv_rows(spark, folder):
    return export.sheet_rows(_questions(spark, folder))


@query()
def svg_cards(spark, folder):
    return export.svg_cards(_questions(spark, folder))


@query(r"""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment || ' ' || (c_custkey % 50) END AS question, CASE WHEN c_custkey % 7 <> 0 THEN 'x' END AS b,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE substr('ABCDEF', (c_nationkey % 6 + 1)::INT, 1) END AS answer FROM customer),
k AS (SELECT *, CASE WHEN question = '' THEN 'missing question' WHEN b IS NULL THEN 'fewer than two options' WHEN answer IS NULL THEN 'missing answer' WHEN answer = 'F' THEN 'invalid answer' END AS reason FROM r)
SELECT id, reason, reason IS NULL AND row_number() OVER (PARTITION BY question, reason IS NULL ORDER BY id) > 1 AS is_duplicate FROM k""")
def csv_import_report(spark, folder):
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        key.alias("id"),
        F.when(key % 11 == 0, "").otherwise(F.concat("c_mktsegment", F.lit(" "), (key % 50).cast("string"))).alias("question"),
        F.lit("y").alias("option_a"), F.when(key % 7 != 0, "x").alias("option_b"), F.lit(None).cast("string").alias("option_c"), F.lit("").alias("option_d"),
        F.when(key % 13 != 0, F.substr(F.lit("ABCDEF"), (F.col("c_nationkey") % 6 + 1).cast("int"), F.lit(1))).alias("answer"),
    )
    return csv_bank.import_report(rows).select("id", "reason", "is_duplicate")


# --- records ---------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT l_partkey % 200 AS figure_id, l_linenumber AS n, l_returnflag || (l_suppkey % 3)::VARCHAR AS value, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_quantity END AS earned, 50.0::DOUBLE AS maximum FROM lineitem),
s AS (SELECT figure_id, n, value, sum(CASE WHEN earned IS NULL THEN 0.5::DOUBLE ELSE greatest(0.05::DOUBLE, earned / maximum) END) AS weight, max(coalesce(earned >= maximum, false)) AS trusted FROM v GROUP BY 1, 2, 3)
SELECT figure_id, n, value, round(weight, 6) AS weight, trusted FROM (SELECT *, row_number() OVER (PARTITION BY figure_id, n ORDER BY trusted DESC, round(weight, 6) DESC, value) AS r FROM s) WHERE r = 1""")
def figure_label_vote(spark, folder):
    rows = table(spark, folder, "lineitem")
    votes = rows.select(
        (F.col("l_partkey") % 200).alias("figure_id"), F.col("l_linenumber").alias("n"), F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("value"),
        F.when(F.col("l_tax") >= 0.02, F.col("l_quantity")).alias("earned"), F.lit(50.0).alias("maximum"),
    )
    return records.figure_labels(votes).withColumn("weight", F.round("weight", 6))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 < o_orderkey % 4 ELSE o_orderkey % 3 > 0 END AS answered FROM orders""")
def answerable(spark, folder):
    key = F.col("o_orderkey")
    options = F.slice(F.split(F.lit("A,B,C"), ","), F.lit(1), (key % 4).cast("int"))
    answer = F.concat(F.lit("Z; "), F.substr(F.lit("ABCDE"), (key % 5 + 1).cast("int"), F.lit(1)))
    return table(spark, folder, "orders").select(key.alias("id"), records.has_answer(answer, options, F.when(key % 3 > 0, "text")).alias("answered"))


@query("""SELECT p_partkey AS id, q AS question, o AS options, a AS answer, round((q + o + CASE WHEN a > 0 THEN a ELSE 0.5 END) / 3, 2) AS overall,
 CASE WHEN round((q + o + CASE WHEN a > 0 THEN a ELSE 0.5 END) / 3, 2) >= 0.85 THEN 'high' WHEN round((q + o + CASE WHEN a > 0 THEN a ELSE 0.5 END) / 3, 2) >= 0.6 THEN 'medium' ELSE 'needs-review' END AS level
FROM (SELECT p_partkey, (CASE WHEN length(p_name) > 10 THEN 0.99 ELSE 0.8 END)::DOUBLE AS q, (CASE WHEN p_size % 6 >= 4 THEN 0.98 WHEN p_size % 6 >= 3 THEN 0.85 ELSE 0.6 END)::DOUBLE AS o, (CASE WHEN p_size % 2 = 0 THEN 0.99 ELSE 0 END)::DOUBLE AS a FROM part)""")
def structured_confidence(spark, folder):
    parts = records.structured(F.col("p_size") % 6, F.length("p_name"), F.col("p_size") % 2 == 0)
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), parts.alias("c")).select("id", "c.*")
    return rows.withColumn("level", records.confidence_level(F.col("overall")))


@query("SELECT o_custkey AS owner, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS value FROM orders GROUP BY 1")
def first_known_blank(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("value"))
    return records.first_known(rows, ["owner"], "o_orderkey", "value")


@query("""WITH h AS (SELECT o_custkey AS key, min(o_orderkey) AS twin_id FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey AS id, twin_id FROM orders JOIN h ON o_custkey = key WHERE o_orderstatus <> 'P'""")
def lone_twins(spark, folder):
    # a status stands for having a picture: every row is on one side
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("s"))
    return records.lone_twins(rows.where("s <> 'P'"), rows.where("s = 'P'"))


@query("""WITH r AS (SELECT * FROM (VALUES (1, 'ring', 'R'), (2, 'a', 'S'), (3, 'o', 'T')) AS t(priority, fragment, given)),
h AS (SELECT p_partkey AS id, arg_min(given, priority) AS given FROM part JOIN r ON contains(p_name, fragment) GROUP BY 1)
SELECT p_partkey AS id, p_name AS question, coalesce(given, p_brand) AS answer, given IS NOT NULL AS overridden FROM part LEFT JOIN h ON id = p_partkey""")
def override_rules(spark, folder):
    rules_ = spark.sql("SELECT * FROM VALUES (1, 'ring', 'R'), (2, 'a', 'S'), (3, 'o', 'T') AS t(priority, fragment, answer)")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_brand").alias("answer"))
    return records.override(rows, rules_)


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'UNRESOLVED' ELSE 'CONFIRMED_BY_SCORE' END AS a,
 CASE o_orderkey % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'PARSED' END AS e FROM orders)
SELECT id, CASE a WHEN 'CONFLICT' THEN 'ANSWER_CONFLICT' WHEN 'NEEDS_REVIEW' THEN 'ANSWER_REVIEW' ELSE 'NO_ANSWER' END AS kind FROM c WHERE a <> 'CONFIRMED_BY_SCORE'
UNION ALL SELECT id, CASE e WHEN 'FAILED' THEN 'EXTRACTION_FAILED' ELSE 'EXTRACTION_REVIEW' END FROM c WHERE e <> 'PARSED'""")
def import_review_tasks(spark, folder):
    key = F.col("o_orderkey")
    a = F.get(F.array(*[F.lit(x) for x in ("CONFLICT", "NEEDS_REVIEW", "UNRESOLVED", "CONFIRMED_BY_SCORE")]), (key % 4).cast("int"))
    e = F.get(F.array(*[F.lit(x) for x in ("FAILED", "NEEDS_REVIEW", "PARSED")]), (key % 3).cast("int"))
    return records.review_tasks(table(spark, folder, "orders").select(key.alias("id"), a.alias("answer_status"), e.alias("extraction_status")))


@query("""WITH s AS (SELECT l_partkey AS group_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A,' || l_returnflag ELSE l_returnflag END AS keys, count(*) AS n FROM (SELECT l_partkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'B' ELSE l_returnflag END AS l_returnflag FROM lineitem) GROUP BY 1, 2)
SELECT group_id, keys, n FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, keys) AS r FROM s) WHERE r = 1""")
def most_frequent_set(spark, folder):
    flag = F.when(F.col("l_returnflag") == "A", "B").otherwise(F.col("l_returnflag"))
    keys = F.when(F.col("l_linenumber") % 2 == 0, F.array(flag, F.lit("A"))).otherwise(F.array(flag))
    return records.most_frequent_set(table(spark, folder, "lineitem").select(F.col("l_partkey").alias("group_id"), keys.alias("keys")))


@query("""WITH s AS (SELECT user_id AS question_id, event_type AS url, min(event_id) AS rank FROM events GROUP BY 1, 2)
SELECT question_id, url, rank, place FROM (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY rank, url))::INTEGER AS place FROM s) WHERE place <= 3""")
def unique_sources(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("url"), F.col("event_id").alias("rank"))
    return records.unique_sources(rows, 3)


@query("""SELECT source AS document_id, count(*) AS pages, avg(length(text)) < 2300 AS scanned FROM documents GROUP BY 1""")
def scanned_documents(spark, folder):
    return records.is_scanned(table(spark, folder, "documents").select(F.col("source").alias("document_id"), "text"), 2300)


@query("""SELECT name, length, modified, min(path) AS path FROM (SELECT 'f' || (o_orderkey % 900) || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END AS name, (o_orderkey % 50) AS length, o_orderstatus AS modified,
 'd' || (o_orderkey % 3) || '/f' || (o_orderkey % 900) || CASE WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.PDF' END AS path FROM orders) WHERE ends_with(lower(name), '.pdf') AND length BETWEEN 1 AND 40 GROUP BY 1, 2, 3""")
def valid_uploads(spark, folder):
    key = F.col("o_orderkey")
    name = F.concat(F.lit("f"), (key % 900).cast("string"), F.when(key % 7 == 0, ".txt").otherwise(".PDF"))
    rows = table(spark, folder, "orders").select(F.concat(F.lit("d"), (key % 3).cast("string"), F.lit("/"), name).alias("path"), (key % 50).alias("length"), F.col("o_orderstatus").alias("modified"))
    return records.valid_uploads(rows, 40)


# --- votes of checks and searches ------------------------------------------------------------------------------------

_CHECKS = "(0, 0.65, 0.15, 2.0, true), (1, 0.5, 0.2, 2.0, true), (2, 0.4, 0.15, 0.5, false)"


@query(f"""WITH k AS (SELECT name, least::DOUBLE AS least, margin::DOUBLE AS margin, weight::DOUBLE AS weight, content FROM (VALUES {_CHECKS}) AS t(name, least, margin, weight, content)),
s AS (SELECT l_partkey AS question_id, l_linenumber % 3 AS name, l_suppkey % 4 AS label, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY question_id, name ORDER BY score DESC, label DESC)),
v AS (SELECT question_id, label, sum(weight) AS votes, bool_or(content) AS content FROM r JOIN k USING (name) WHERE r.k = 1 AND score >= least AND score - second >= margin GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER w AS k, coalesce(lead(votes) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY question_id ORDER BY votes DESC, content DESC, label DESC))
SELECT question_id, label AS winner, votes FROM t WHERE k = 1 AND content AND votes - second >= 1""")
def source_check_vote(spark, folder):
    rows = table(spark, folder, "lineitem")
    scores = rows.groupBy(F.col("l_partkey").alias("question_id"), (F.col("l_linenumber") % 3).alias("name"), (F.col("l_suppkey") % 4).alias("label")).agg((F.max("l_quantity") / 50).alias("score"))
    checks = spark.sql(f"SELECT name, cast(least AS double) AS least, cast(margin AS double) AS margin, cast(weight AS double) AS weight, content FROM VALUES {_CHECKS} AS t(name, least, margin, weight, content)")
    return lookup.vote(scores, checks)


@query("""WITH c AS (SELECT user_id AS question_id, event_type AS title, count(DISTINCT event_id % 5) AS n FROM events GROUP BY 1, 2), b AS (SELECT question_id, max(n) AS n FROM c GROUP BY 1)
SELECT question_id, min(title) AS title, n FROM c JOIN b USING (question_id, n) WHERE n >= 2 GROUP BY question_id, n HAVING count(*) = 1""")
def search_tally(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("question_id"), (F.col("event_id") % 5).alias("search"), F.col("event_type").alias("title"))
    return lookup.search_tally(rows)


@query(f"""WITH {_SENTENCES}, n AS (SELECT source_id, pos, regexp_matches(sentence, '(?i)(^|[^a-z])(not|no|never|without)([^a-z]|$)') AS said FROM t),
z AS (SELECT question_id, source_id, pos, score, NOT said AS agrees FROM e JOIN n USING (source_id, pos) WHERE score >= 0.8),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, agrees DESC, source_id, pos) AS r FROM z)
SELECT question_id, CASE WHEN agrees THEN 'TRUE' ELSE 'FALSE' END AS verdict, score FROM k WHERE r = 1 AND (agrees OR score >= 0.9)""")
def judge_statements(spark, folder):
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return lookup.judge_statements(questions, table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text"))


# --- the document engine ---------------------------------------------------------------------------------------------


@query("""SELECT n_regionkey::VARCHAR AS document_id, 0 AS attempt, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS number, 'Region of ' || n_name || '?' AS stem, 5 AS n_options,
 r_name AS answer, 'CONFIRMED_BY_DOCUMENT' AS status FROM nation JOIN region ON n_regionkey = r_regionkey""")
def analyze_positioned_exam(spark, folder):
    found = engine.analyze(adapters.positioned_pages(spark, folder))
    answer = F.array_join(F.transform("right", lambda i: F.get("options", i)["text"]), "|")
    return found.select("document_id", "attempt", "number", "stem", F.size("options").alias("n_options"), answer.alias("answer"), "status")


@query("""WITH r AS (SELECT document_id, number, count(*) OVER (PARTITION BY document_id) AS n FROM (SELECT n_regionkey::VARCHAR AS document_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number FROM nation))
SELECT document_id, role, count FROM (SELECT document_id, 'OPTION' AS role, sum(6)::BIGINT AS count FROM r GROUP BY 1 UNION ALL SELECT document_id, 'FEEDBACK', count(*) FROM r GROUP BY 1 UNION ALL SELECT DISTINCT document_id, 'NOISE', 1 FROM r)""")
def classified_lines(spark, folder):
    lines = engine.classify(engine.build_lines(adapters.positioned_pages(spark, folder)))
    return lines.groupBy("document_id", "role").count()


@query()
def greedy_clusters(spark, folder):
    stems = adapters.stems(spark, folder).withColumn("document_id", F.lit("d")).withColumn("sequence", F.col("id"))
    return resolve.cluster(stems, work_folder(spark, "cluster"))
