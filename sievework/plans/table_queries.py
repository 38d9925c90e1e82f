"""Queries over whole tables. A documented role stands for each entity: an event is an operation attempt, an order a task or
posting, a document a profile's content, a label a reference to evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.columns import BANDS, age_class, band, posting_age
from sievework.functions.facts import first_matching_sentence, sentences
from sievework.operators import accounting, contexts, history
from sievework.operators.ordinals import ordinals
from sievework.operators.similarity import duplicate_decisions
from sievework.sources.tables import table

PRICES = """(VALUES
  ('view', 'v1', 2.0, 0.2, 12.0, 50, 2.0, 1.5, 'USD'), ('view', 'v2', 0.2, 0.02, 1.2, 50, 2.0, 1.5, 'USD'),
  ('click', 'v1', 2.0, 0.2, 12.0, 50, 2.0, 1.5, 'USD'), ('click', 'v2', 0.2, 0.02, 1.2, 50, 2.0, 1.5, 'USD'),
  ('signup', 'v1', 1.0, 0.1, 6.0, 80, 2.0, 1.5, 'USD'), ('signup', 'v2', 1.0, 0.1, 6.0, 80, 2.0, 1.5, 'USD'),
  ('error', 'v1', 1.0, 0.1, 6.0, 80, 2.0, 1.5, 'USD'), ('error', 'v2', 1.0, 0.1, 6.0, 80, 2.0, 1.5, 'USD'),
  ('purchase', 'v1', 3.0, 0.3, 9.0, 90, 2.0, 1.5, 'USD'), ('purchase', 'v2', 3.0, 0.3, 9.0, 90, 2.0, 1.5, 'EUR')
) AS p(model, version, price_input, price_cached, price_output, threshold, input_factor, output_factor, currency)"""

ATTEMPTS = """(SELECT *, CASE WHEN tokens_in % 16 <> 0 THEN CAST(floor(tokens_in / 4) AS BIGINT) END AS cached FROM (
  SELECT event_id, ts, user_id AS evaluation_id, event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS version,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in, CAST(floor(value) AS BIGINT) AS out,
    CAST(floor(value / 3) AS BIGINT) AS reasoning, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) + CAST(floor(value) AS BIGINT) AS total FROM events))"""


def cost_sql(tokens_in: str, cached: str, out: str) -> str:
    n, m, f = (lambda x: f"CAST({x} AS DECIMAL(10,0))"), (lambda x: f"CAST({x} AS DECIMAL(8,4))"), (lambda x: f"CAST(CASE WHEN {tokens_in} > threshold THEN {x} ELSE 1 END AS DECIMAL(4,2))")
    million = "CAST(0.000001 AS DECIMAL(6,6))"
    return (
        f"CASE WHEN {tokens_in} IS NOT NULL AND {cached} IS NOT NULL AND {out} IS NOT NULL AND {cached} <= {tokens_in} THEN "
        f"{n(f'{tokens_in} - {cached}')} * {m('price_input')} * {f('input_factor')} * {million} + {n(cached)} * {m('price_cached')} * {f('input_factor')} * {million}"
        f" + {n(out)} * {m('price_output')} * {f('output_factor')} * {million} END"
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    return accounting.attempts_of_events(table(spark, folder, "events"))


def usage_summary(spark, folder):
    prices = spark.sql(f"SELECT * FROM {PRICES}")
    return accounting.usage_summary(accounting.priced(attempts(spark, folder), prices))


USAGE_SUMMARY = f"""
WITH priced AS (SELECT a.*, currency, {cost_sql('tokens_in', 'cached', 'out')} AS cost FROM {ATTEMPTS} a LEFT JOIN {PRICES} USING (model, version)),
seen AS (SELECT evaluation_id, version, min(ts) AS first_ts FROM priced GROUP BY ALL),
listed AS (SELECT evaluation_id, string_agg(version, ',' ORDER BY first_ts) AS versions FROM seen GROUP BY 1)
SELECT p.evaluation_id, count(*) AS attempts,
  CASE WHEN count(tokens_in) = count(*) THEN CAST(sum(tokens_in) AS BIGINT) END AS tokens_in,
  CASE WHEN count(cached) = count(*) THEN CAST(sum(cached) AS BIGINT) END AS cached,
  CASE WHEN count(out) = count(*) THEN CAST(sum(out) AS BIGINT) END AS tokens_out, CASE WHEN count(reasoning) = count(*) THEN CAST(sum(reasoning) AS BIGINT) END AS reasoning,
  CASE WHEN count(total) = count(*) THEN CAST(sum(total) AS BIGINT) END AS total,
  CASE WHEN count(cost) = count(*) AND count(DISTINCT currency) = 1 THEN CAST(sum(cost) AS DOUBLE) END AS cost, CASE WHEN count(cost) = count(*) AND count(DISTINCT currency) = 1 THEN min(currency) END AS currency,
  any_value(versions) AS versions
FROM priced p JOIN listed l ON p.evaluation_id = l.evaluation_id GROUP BY p.evaluation_id"""


def price_check(spark, folder):
    prices = spark.sql(f"SELECT * FROM {PRICES} WHERE NOT (model = 'error' AND version = 'v2')")
    return accounting.price_problems(attempts(spark, folder), prices.unionByName(prices.where("model = 'view'")))


PRICE_CHECK = f"""
WITH base AS (SELECT model, version FROM {PRICES} WHERE NOT (model = 'error' AND version = 'v2')),
prices AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE model = 'view')
SELECT DISTINCT model, version, 'missing' AS problem FROM {ATTEMPTS} a WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.model = a.model AND p.version = a.version)
UNION ALL SELECT model, version, 'duplicate' FROM prices GROUP BY ALL HAVING count(*) > 1"""


def attempt_ordinal(spark, folder):
    return accounting.with_ordinals(attempts(spark, folder), 40)


ATTEMPT_ORDINAL = f"""
SELECT event_id, evaluation_id, row_number() OVER (PARTITION BY evaluation_id, model ORDER BY ts, event_id) AS attempt,
  count(*) OVER w AS calls_before, count(*) OVER w < 40 AS allowed FROM {ATTEMPTS}
WINDOW w AS (PARTITION BY evaluation_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def next_attempt(spark, folder):
    return accounting.next_attempt(attempts(spark, folder))


NEXT_ATTEMPT = "SELECT user_id AS evaluation_id, event_type AS model, count(*) + 1 AS next_attempt FROM events GROUP BY ALL"


def latest_per_key(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return history.first_by(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


LATEST_PER_KEY = "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def history_flags(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    task = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("task_status"))
    flagged = history.flagged_latest(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).join(task, "o_orderkey", "left")
    return flagged.select("o_custkey", "o_orderkey", "is_latest", F.coalesce("task_status", "o_orderstatus").alias("status"))


HISTORY_FLAGS = """
WITH task AS (SELECT l_orderkey, max(l_linestatus) AS task_status FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest,
  coalesce(task_status, o_orderstatus) AS status FROM orders LEFT JOIN task ON l_orderkey = o_orderkey"""


def evaluation_history(spark, folder):
    """All evaluations of each opportunity with their task's status and what was recommended, the newest marked; unknown parts stay null."""
    decided = table(spark, folder, "events").select(F.col("event_id").alias("o_orderkey"), F.col("event_type").alias("decision"))
    task = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("task_status"))
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    flagged = history.flagged_latest(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return flagged.join(task, "o_orderkey", "left").join(decided, "o_orderkey", "left").select("o_custkey", "o_orderkey", "o_orderstatus", "is_latest", "task_status", "decision")


EVALUATION_HISTORY = """
WITH task AS (SELECT l_orderkey, max(l_linestatus) AS task_status FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest, task_status, event_type AS decision
FROM orders LEFT JOIN task ON l_orderkey = o_orderkey LEFT JOIN events ON event_id = o_orderkey"""


def source_of_evaluation(spark, folder):
    """Each order with the source that its provenance names, else the customer's own, else the nation's first source (a supplier)."""
    provenance = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("named"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    known = suppliers.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("named"), F.lit(True).alias("known"))
    first = suppliers.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("first_source"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("own_source"))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(provenance, "o_orderkey", "left").join(known, "named", "left").join(customers, "o_custkey", "left").join(first, "c_nationkey", "left")
    return rows.select("o_orderkey", F.coalesce(F.when(F.col("known"), F.col("named")), "own_source", "first_source").alias("source"))


SOURCE_OF_EVALUATION = """
WITH n AS (SELECT l_orderkey, arg_min(l_suppkey, {'a': l_linenumber, 'b': l_suppkey}) AS named FROM lineitem GROUP BY 1), f AS (SELECT s_nationkey, min(s_suppkey) AS first_source FROM supplier GROUP BY 1)
SELECT o_orderkey, coalesce(s_suppkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END, first_source) AS source FROM orders LEFT JOIN n ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = named AND s_suppkey % 3 <> 0 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN f ON f.s_nationkey = c_nationkey"""


def first_per_key(spark, folder):
    """Every customer with the first order's priority, or the segment where there is no order."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    first = history.first_by(orders, ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = customers.join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "o_orderkey", F.coalesce("o_orderpriority", "c_mktsegment").alias("source"))


FIRST_PER_KEY = """
SELECT c_custkey, o_orderkey, coalesce(o_orderpriority, c_mktsegment) AS source FROM customer LEFT JOIN
  (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) o ON c_custkey = o_custkey"""


def latest_profile(spark, folder):
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


LATEST_PROFILE = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1"


def _arrivals(spark, folder):
    return table(spark, folder, "documents").select(F.col("source").alias("label"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("arrival"))


def version_assignment(spark, folder):
    return history.versions(_arrivals(spark, folder))


_VERSIONS = "(SELECT source AS label, sha256(text) AS content_hash, min(doc_id) AS first_arrival, count(*) AS imports FROM documents GROUP BY ALL)"
VERSION_ASSIGNMENT = f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY first_arrival, content_hash) AS version FROM {_VERSIONS}"


def next_version(spark, folder):
    return history.next_versions(history.versions(_arrivals(spark, folder)))


NEXT_VERSION = f"SELECT label, count(*) + 1 AS next_version FROM {_VERSIONS} GROUP BY 1"


def exact_duplicates(spark, folder):
    groups = _arrivals(spark, folder).groupBy("content_hash").agg(F.min("arrival").alias("kept"), F.count("*").alias("copies"))
    return groups.where("copies > 1").select("content_hash", "kept", "copies", F.lit("DUPLICATE").alias("decision"))


EXACT_DUPLICATES = "SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies, 'DUPLICATE' AS decision FROM documents GROUP BY 1 HAVING count(*) > 1"


def duplicate_decision(spark, folder):
    """Whether each document repeats an earlier one, word for word or nearly."""
    return duplicate_decisions(table(spark, folder, "documents"), "doc_id", "text")


DUPLICATE_DECISION = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
own AS (SELECT doc_id, nullif(array_to_string(w, ' '), '') AS content, w FROM d),
t AS (SELECT content, min(doc_id) AS first_id, any_value(w) AS w FROM own WHERE content IS NOT NULL GROUP BY 1),
s AS (SELECT first_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [content] END AS g FROM t),
e AS (SELECT first_id AS id, unnest(g) AS k, len(g) AS n FROM s),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT first_id, first_id FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id AS first_id, min(root) AS class_id FROM r GROUP BY 1),
q AS (SELECT c.first_id, count(*) AS common FROM c JOIN e x ON x.id = c.first_id JOIN e y ON y.id = class_id AND y.k = x.k WHERE c.first_id <> class_id GROUP BY 1),
j AS (SELECT c.*, common, len(x.g) + len(y.g) - common AS every FROM c JOIN s x ON x.first_id = c.first_id JOIN s y ON y.first_id = class_id LEFT JOIN q ON q.first_id = c.first_id),
o AS (SELECT own.doc_id, j.*, CASE WHEN j.first_id < doc_id THEN 'MATCH' WHEN class_id < doc_id THEN 'PROBABLE_MATCH' ELSE 'NO_MATCH' END AS decision FROM own LEFT JOIN t ON t.content = own.content LEFT JOIN j ON j.first_id = t.first_id)
SELECT doc_id, decision, CAST(CASE decision WHEN 'MATCH' THEN 1 WHEN 'PROBABLE_MATCH' THEN floor((20000 * common + every) / (2 * every)) / 10000 END AS DECIMAL(5,4)) AS confidence,
  CASE decision WHEN 'MATCH' THEN first_id WHEN 'PROBABLE_MATCH' THEN class_id END AS related_id, coalesce(class_id, doc_id) AS class_id FROM o"""


def reference_integrity(spark, folder):
    """References (labels) whose evidence (an English document) is not there."""
    evidence = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, folder, "labels").join(evidence, "doc_id", "left_anti").select("doc_id", F.lit("missing_reference").alias("rule"))


REFERENCE_INTEGRITY = "SELECT doc_id, 'missing_reference' AS rule FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')"


def ownership_check(spark, folder):
    """Lines whose order exists and is finished; the rest would be refused."""
    owned = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").join(owned, "l_orderkey", "left_semi")


OWNERSHIP_CHECK = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"


def resolvable_links(spark, folder):
    """Of each order's parts, in line order, those that can be resolved (size up to 25), each once."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, folder, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    known = lines.join(parts, "l_partkey").withColumn("pos", F.struct("l_linenumber", "l_suppkey"))
    return history.ordered_union(known, "l_orderkey", "pos", "l_partkey")


RESOLVABLE_LINKS = """
WITH known AS (SELECT l_orderkey, l_partkey, min({'n': l_linenumber, 's': l_suppkey}) AS pos FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1, 2)
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY pos, l_partkey) AS items, CAST(count(*) AS INTEGER) AS n_items FROM known GROUP BY 1"""


def evidence_catalog(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", "profile-").otherwise("jd-").alias("kind"))
    return ordinals(docs, ["source", "kind"], ["doc_id"]).select("doc_id", "source", F.concat("kind", F.col("nth") - 1).alias("catalog_id"))


EVIDENCE_CATALOG = """SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'profile-' ELSE 'jd-' END ||
  (row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id) - 1) AS catalog_id FROM documents"""


def reference_restore(spark, folder):
    """Indexes (turn of a conversation) back to the evidence with that ordinal in a source's catalog; others are out of bounds."""
    docs = table(spark, folder, "documents").where("lang = 'en'").select("source", "doc_id")
    catalog = ordinals(docs, ["source"], ["doc_id"]).select("source", "doc_id", (F.col("nth") - 1).alias("idx"))
    asked = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("src"), F.col("conv_id") % 20).alias("source"), F.col("turn").alias("idx"))
    out = asked.join(catalog, ["source", "idx"], "left")
    return out.select("conv_id", "turn", "doc_id", F.when(F.col("doc_id").isNull(), "out_of_bounds").alias("violation"))


REFERENCE_RESTORE = """
WITH catalog AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents WHERE lang = 'en')
SELECT conv_id, turn, doc_id, CASE WHEN doc_id IS NULL THEN 'out_of_bounds' END AS violation FROM conversations
LEFT JOIN catalog ON catalog.source = 'src' || (conv_id % 20) AND idx = turn"""


def first_wins(spark, folder):
    return history.first_by(table(spark, folder, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.asc("event_id"))


FIRST_WINS = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"


def last_wins_union(spark, folder):
    """Two sources of values by reference; the later source's last value holds at the first position."""
    events = table(spark, folder, "events").select("user_id", "event_id", "value")
    first = events.where("event_id % 2 = 0").select("user_id", F.struct(F.lit(1).alias("source"), "event_id").alias("pos"), "value")
    second = events.where("event_id % 2 = 1").select("user_id", F.struct(F.lit(2).alias("source"), "event_id").alias("pos"), "value")
    return history.last_wins(first.unionByName(second), "user_id", "pos", "value").select("user_id", "pos.*", "value")


LAST_WINS_UNION = """SELECT user_id, CAST(pos.source AS INTEGER) AS source, pos.event_id AS event_id, value FROM (SELECT user_id, min(pos) AS pos, arg_max(value, pos) AS value
FROM (SELECT user_id, {'source': 1 + event_id % 2, 'event_id': event_id} AS pos, value FROM events) GROUP BY 1)"""


def ordered_union(spark, folder):
    return history.ordered_union(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


ORDERED_UNION = """SELECT user_id, string_agg(event_type, ',' ORDER BY pos) AS items, CAST(count(*) AS INTEGER) AS n_items
FROM (SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY 1"""


def append_absent(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return history.absent(orders.select("o_orderkey", "o_custkey"), lines.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


APPEND_ABSENT = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"


def coverage_gap(spark, folder):
    """Event types that a user never had."""
    every = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    had = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("had"))
    return had.select("user_id", F.array_join(F.array_except(every, "had"), ",").alias("missing"), (F.size(F.array_except(every, "had")) == 0).alias("complete"))


COVERAGE_GAP = """
WITH had AS (SELECT DISTINCT user_id, event_type FROM events), users AS (SELECT DISTINCT user_id FROM events),
missing AS (SELECT u.user_id, t FROM users u CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS e(t) WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.user_id = u.user_id AND h.event_type = t))
SELECT u.user_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS missing, count(t) = 0 AS complete FROM users u LEFT JOIN missing m ON m.user_id = u.user_id GROUP BY 1"""


def uniqueness_violations(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("times")).where("times > 1")


UNIQUENESS_VIOLATIONS = "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def posting_ages(spark, folder):
    days = posting_age(F.lit("2001-07-20").cast("date"), F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", days.alias("age_days"), age_class(days).alias("age_class"))


POSTING_AGES = """
SELECT o_orderkey, age_days, CASE WHEN age_days IS NULL THEN 'UNKNOWN' WHEN age_days <= 3 THEN 'HIGHEST_PRIORITY' WHEN age_days <= 7 THEN 'STRONG_PRIORITY'
  WHEN age_days <= 14 THEN 'GOOD_OPPORTUNITY' WHEN age_days <= 21 THEN 'REVIEW' ELSE 'CAUTION' END AS age_class
FROM (SELECT o_orderkey, CASE WHEN d >= 0 THEN CAST(d AS INTEGER) END AS age_days FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-07-20') AS d FROM orders))"""


def score_bands(spark, folder):
    score = F.floor("value").cast("int")
    return table(spark, folder, "events").select("event_id", *(band(score, k).alias(k) for k in BANDS))


SCORE_BANDS = "SELECT event_id, " + ", ".join(
    f"CASE WHEN s < 0 OR s > 100 THEN NULL WHEN s <= 19 THEN '{b[0]}' WHEN s <= 39 THEN '{b[1]}' WHEN s <= 59 THEN '{b[2]}' WHEN s <= 79 THEN '{b[3]}' ELSE '{b[4]}' END AS {k}" for k, b in BANDS.items()
) + " FROM (SELECT event_id, CAST(floor(value) AS INTEGER) AS s FROM events)"


def sentence_split(spark, folder):
    # exploded from a list of one, as a filter on a plain column would be pushed below and split every text once more
    docs = table(spark, folder, "documents").select("doc_id", F.explode(F.array(F.transform(sentences(F.col("text")), F.length))).alias("sizes")).where(F.size("sizes") > 0)
    chars = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("sizes").cast("long").alias("n_sentences"), F.array_max("sizes").alias("longest"), chars.alias("chars"))


_SPLIT = r"list_transform(string_split(regexp_replace(regexp_replace(text, '\r?\n', chr(1), 'g'), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
SENTENCE_SPLIT = f"""
WITH s AS (SELECT doc_id, unnest({_SPLIT}) AS sentence FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(max(length(sentence)) AS INTEGER) AS longest, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM s WHERE sentence <> '' GROUP BY 1"""


def first_sentence(spark, folder):
    return table(spark, folder, "documents").select("doc_id", first_matching_sentence(F.col("text"), "licen[sc]e").alias("sentence")).where("sentence is not null")


FIRST_SENTENCE = f"""
SELECT doc_id, sentence FROM (SELECT doc_id, list_filter({_SPLIT}, lambda x: regexp_matches(x, 'licen[sc]e', 'i'))[1] AS sentence FROM documents) WHERE sentence IS NOT NULL"""


def _stages(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").alias("evaluation_id"), F.col("event_id").alias("position"), F.col("event_type").alias("stage_id"), (F.col("value") >= 10).alias("completed"))


def stage_context(spark, folder):
    """What each stage sees: all completed stages before it, in order."""
    before = Window.partitionBy("evaluation_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.when(F.col("completed"), F.col("stage_id"))).over(before)
    return _stages(spark, folder).select("evaluation_id", "position", F.count("*").over(before).alias("before"), F.array_join(seen, ">").alias("context"))


STAGE_CONTEXT = """
SELECT user_id AS evaluation_id, event_id AS position, count(*) OVER before AS before,
  coalesce(string_agg(CASE WHEN value >= 10 THEN event_type END, '>') OVER before, '') AS context
FROM events WINDOW before AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def stage_chain(spark, folder):
    """The same as pointers: a row a stage, however many come before it."""
    return contexts.chained(_stages(spark, folder))


STAGE_CHAIN = """
SELECT user_id AS evaluation_id, event_id AS position, max(CASE WHEN value >= 10 THEN event_id END) OVER before AS parent, CASE WHEN value >= 10 THEN event_type END AS delta,
  count(CASE WHEN value >= 10 THEN 1 END) OVER before AS nth
FROM events WINDOW before AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def stage_context_asked(spark, folder):
    """The contexts of failed stages, put together from the pointers."""
    stages = _stages(spark, folder)
    return contexts.expanded(contexts.chained(stages), stages.where("not completed"))


STAGE_CONTEXT_ASKED = """
SELECT evaluation_id, position, context FROM (SELECT user_id AS evaluation_id, event_id AS position, value, coalesce(string_agg(CASE WHEN value >= 10 THEN event_type END, '>') OVER before, '') AS context
FROM events WINDOW before AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE value < 10"""


def stage_pivot(spark, folder):
    ids = ["click", "error", "purchase", "signup", "view"]
    return _stages(spark, folder).groupBy("evaluation_id").pivot("stage_id", ids).agg(F.max("position"))


STAGE_PIVOT = "SELECT user_id AS evaluation_id, " + ", ".join(f"max(event_id) FILTER (event_type = '{k}') AS {k}" for k in ["click", "error", "purchase", "signup", "view"]) + " FROM events GROUP BY 1"


def pipeline_outcome(spark, folder):
    last = _stages(spark, folder).groupBy("evaluation_id", "stage_id").agg(F.max_by("completed", "position").alias("completed"))
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("completed"), F.col("stage_id")))), ", ")
    out = last.groupBy("evaluation_id").agg(failed.alias("failed_stages"))
    return out.select("evaluation_id", "failed_stages", F.when(F.col("failed_stages") == "", "COMPLETED").otherwise("FAILED").alias("outcome"))


PIPELINE_OUTCOME = """
WITH last AS (SELECT user_id, event_type, arg_max(value >= 10, event_id) AS completed FROM events GROUP BY ALL)
SELECT user_id AS evaluation_id, coalesce(string_agg(event_type, ', ' ORDER BY event_type) FILTER (NOT completed), '') AS failed_stages,
  CASE WHEN bool_and(completed) THEN 'COMPLETED' ELSE 'FAILED' END AS outcome FROM last GROUP BY 1"""


def _tasks(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("available_at"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETED' END").alias("status"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        F.when(F.col("o_orderstatus") == "P", F.expr("o_orderdate + INTERVAL 2 DAYS")).alias("lease_expires_at"), F.expr("CAST('1998-06-01' AS TIMESTAMP_NTZ)").alias("now"),
    )


TASKS = """(SELECT o_orderkey AS task_id, o_orderdate AS created_at, o_orderdate AS available_at, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
  CAST(o_orderkey % 4 AS INTEGER) AS attempt, 3 AS max_attempts, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 2 DAY END AS lease_expires_at, TIMESTAMP '1998-06-01' AS now FROM orders)"""


def task_claim(spark, folder):
    return history.claimed(_tasks(spark, folder), 300)


_OPEN = "attempt < max_attempts AND ((status = 'PENDING' AND available_at <= now) OR (status = 'RUNNING' AND lease_expires_at < now))"
_CAN = f"coalesce({_OPEN}, false)"
TASK_CLAIM = f"""SELECT task_id, {_CAN} AS claimable, CASE WHEN {_CAN} THEN 'RUNNING' ELSE status END AS status_after, attempt + CAST({_CAN} AS INTEGER) AS attempt_after,
  CASE WHEN {_CAN} THEN now + INTERVAL 300 SECOND ELSE lease_expires_at END AS lease_after FROM {TASKS}"""


def task_queue_head(spark, folder):
    return history.queue_head(_tasks(spark, folder)).select("task_id", "status", "attempt")


TASK_QUEUE_HEAD = f"SELECT task_id, status, attempt FROM {TASKS} WHERE {_OPEN} ORDER BY created_at, task_id LIMIT 1"


def task_batches(spark, folder):
    """Eight workers claim up to fifty tasks each."""
    return history.claim_batches(_tasks(spark, folder), 8, 50)


TASK_BATCHES = f"""
WITH r AS (SELECT task_id, row_number() OVER (ORDER BY created_at, task_id) - 1 AS k FROM {TASKS} WHERE {_OPEN})
SELECT task_id, CAST(k % 8 AS INTEGER) AS worker, CAST(k // 8 AS INTEGER) AS nth FROM r WHERE k < 400"""


def task_transition(spark, folder):
    tasks = _tasks(spark, folder).where("status = 'RUNNING'")
    return history.finished(tasks.withColumns({"succeeded": F.col("task_id") % 3 == 0, "retryable": F.col("task_id") % 2 == 0}))


TASK_TRANSITION = f"""SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'COMPLETED' WHEN task_id % 2 = 0 AND attempt < max_attempts THEN 'PENDING' ELSE 'FAILED' END AS status_after
FROM {TASKS} WHERE status = 'RUNNING'"""


def task_work(spark, folder):
    """A worker's step over all tasks; every fifth order has no outcome yet, and every seventh failed in an unknown way."""
    tasks = _tasks(spark, folder)
    key = F.col("task_id")
    outcomes = tasks.where("task_id % 5 <> 0").select("task_id", (key % 3 == 0).alias("succeeded"), F.when(key % 7 != 0, key % 2 == 0).alias("retryable"))
    return history.worked(tasks, outcomes, 300)


TASK_WORK = f"""
WITH t AS (SELECT *, coalesce((attempt < max_attempts AND ((status = 'PENDING' AND available_at <= now) OR (status = 'RUNNING' AND lease_expires_at < now))), false) AS can FROM {TASKS}),
u AS (SELECT *, attempt + CAST(can AS INTEGER) AS tries FROM t),
s AS (SELECT *, CASE WHEN NOT can THEN status WHEN task_id % 5 = 0 THEN 'RUNNING' WHEN task_id % 3 = 0 THEN 'COMPLETED' WHEN task_id % 7 <> 0 AND task_id % 2 = 0 AND tries < max_attempts THEN 'PENDING' ELSE 'FAILED' END AS after FROM u)
SELECT task_id, after AS status, tries AS attempt, CASE WHEN after = 'RUNNING' THEN CASE WHEN can THEN now + INTERVAL 300 SECOND ELSE lease_expires_at END END AS lease_expires_at FROM s"""


def call_outcomes(spark, folder):
    """A user's events of one kind as the attempts of a call, at most three."""
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    key = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ["PROVIDER_FAILURE", "VALIDATION_FAILURE", "TIMEOUT", "PROVIDER_FAILURE", "SUCCESS"])), (key % 5 + 1).cast("int"))
    http = F.when(key % 5 == 0, F.element_at(F.array(*map(F.lit, [500, 404, 429])), (key % 3 + 1).cast("int")))
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    calls = events.select(F.concat_ws("-", "user_id", "event_type").alias("call_id"), nth.alias("nth"), status.alias("status"), http.alias("http"))
    return history.call_outcomes(calls, 2)


CALL_OUTCOMES = """
WITH e AS (SELECT user_id || '-' || event_type AS call_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth, event_id % 5 AS k, CASE WHEN event_id % 5 = 0 THEN [500, 404, 429][event_id % 3 + 1] END AS http FROM events),
m AS (SELECT *, (k IN (1, 2) OR (k IN (0, 3) AND coalesce(http IN (408, 429) OR http >= 500, false))) AS again, CASE k WHEN 1 THEN 'STRUCTURED_OUTPUT_INVALID' WHEN 2 THEN 'PROVIDER_TIMEOUT' WHEN 4 THEN NULL ELSE 'PROVIDER_REQUEST_FAILED' END AS code FROM e WHERE nth <= 3),
c AS (SELECT call_id, min(nth) FILTER (NOT again) AS final, max(nth) AS most FROM m GROUP BY 1)
SELECT c.call_id, CAST(coalesce(final, most) AS INTEGER) AS attempts, m.code, CASE WHEN final IS NOT NULL THEN false WHEN most < 3 THEN true ELSE m.code <> 'STRUCTURED_OUTPUT_INVALID' END AS retryable FROM c JOIN m ON m.call_id = c.call_id AND m.nth = coalesce(final, most)"""


def retry_classes(spark, folder):
    http = F.element_at(F.array(*map(F.lit, [200, 400, 404, 408, 429, 500, 503])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", history.retry_class(http, F.col("event_id") % 11 == 0).alias("retry_class"))


RETRY_CLASSES = """SELECT event_id, CASE WHEN event_id % 11 = 0 OR http IN (408, 429) OR http >= 500 THEN 'RETRYABLE' WHEN http < 400 THEN 'OK' ELSE 'FATAL' END AS retry_class
FROM (SELECT event_id, [200, 400, 404, 408, 429, 500, 503][event_id % 7 + 1] AS http FROM events)"""

NAMES = (
    "usage_summary price_check attempt_ordinal next_attempt latest_per_key history_flags evaluation_history source_of_evaluation first_per_key latest_profile version_assignment next_version exact_duplicates duplicate_decision "
    "reference_integrity ownership_check resolvable_links evidence_catalog reference_restore first_wins last_wins_union ordered_union append_absent coverage_gap uniqueness_violations "
    "posting_ages score_bands sentence_split first_sentence stage_context stage_chain stage_context_asked stage_pivot pipeline_outcome task_claim task_queue_head task_batches task_transition retry_classes task_work call_outcomes"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
