"""Queries over evidence, lookups and state transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievework.functions import columns as c
from sievework.functions import rules
from sievework.operators import evidence, history
from sievework.plans.case_queries import Rows, pick
from sievework.sources.shared import shared_folder
from sievework.sources.tables import table
from sievework.streaming.upserts import StoredTable

STAGES = ["hard_filters", "company", "resume_match", "fit", "burnout", "maturity", "priority", "history", "recommendation"]


def detail_children(spark, folder):
    """An order with its customer and its lines, ordered and nested."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = orders.join(customers, "o_custkey", "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "c_name", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("children"))


DETAIL_CHILDREN = """
WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS children FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, children FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey"""


def evaluation_create(spark, folder):
    """The pending stage rows of new evaluations, numbered from 0."""
    orders = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("evaluation_id"))
    return orders.select("evaluation_id", F.posexplode(F.array(*map(F.lit, STAGES))).alias("position", "stage_id"), F.lit("PENDING").alias("status"))


EVALUATION_CREATE = f"SELECT o_orderkey AS evaluation_id, unnest(range({len(STAGES)}))::INTEGER AS position, unnest({STAGES}) AS stage_id, 'PENDING' AS status FROM orders WHERE o_orderstatus = 'O'"


def lifecycle_change(spark, folder):
    """A status changes only from the one it is expected to have; the others are reported."""
    expected = F.col("o_orderstatus") == "O"
    return table(spark, folder, "orders").select("o_orderkey", F.when(expected, "NORMALIZED").otherwise(F.col("o_orderstatus")).alias("status"), F.when(~expected, "stale").alias("violation"))


LIFECYCLE_CHANGE = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'NORMALIZED' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'O' THEN 'stale' END AS violation FROM orders"


def pruned_lookup(spark, folder):
    """Urgent orders that have a line with a discount: five columns and a semi join."""
    priority = "1-URGENT"
    wanted = F.lit(priority).isNull() | (F.col("o_orderpriority") == priority)
    some = table(spark, folder, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").where(wanted).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").join(some, "o_orderkey", "left_semi")


PRUNED_LOOKUP = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)"


def backfill(spark, folder):
    """A value taken over from the parent row where the child has none."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return lines.join(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey", F.coalesce("flag", "o_orderpriority").alias("flag"))


BACKFILL = "SELECT l_orderkey, l_linenumber, l_suppkey, o_custkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, o_orderpriority) AS flag FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey"


def recommendation_upsert(spark, folder):
    """The last write of each user holds."""
    return history.first_by(table(spark, folder, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], F.desc("ts"), F.desc("event_id")).drop("ts")


RECOMMENDATION_UPSERT = "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"



def stored_upsert(spark, folder):
    """Three batches of events into a stored table with a row a user, the second once more at the end; what came first stays as it was."""
    events = table(spark, folder, "events").select("user_id", "event_type", "value", "event_id", F.col("event_id").alias("first_event"), "ts")
    stored = StoredTable(spark, f"{shared_folder(spark)}/sievework/stored-{uuid.uuid4().hex}/table", events.drop("ts").schema, ["user_id"], once=("first_event",))
    for batch in (0, 1, 2, 1):
        stored.merge(events.where(F.col("event_id") % 3 == batch), batch, "ts", "event_id")
    return stored.read()


STORED_UPSERT = """
WITH l AS (SELECT *, event_id % 3 AS batch FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, arg_max(event_type, batch) AS event_type, arg_max(value, batch) AS value, max(event_id) FILTER (last) AS event_id, min(event_id) FILTER (first) AS first_event
FROM (SELECT *, batch = max(batch) OVER (PARTITION BY user_id) AS last, batch = min(batch) OVER (PARTITION BY user_id) AS first FROM l) GROUP BY 1"""


def stored_versions(spark, folder):
    """Documents imported in three batches: a source's texts get versions in the order they first come, batch by batch; the first batch comes twice."""
    docs = table(spark, folder, "documents").select(F.col("source").alias("label"), F.sha2("text", 256).alias("content_hash"), "doc_id", F.lit(None).cast("long").alias("version"))
    stored = StoredTable(spark, f"{shared_folder(spark)}/sievework/stored-{uuid.uuid4().hex}/table", docs.schema, ["label", "content_hash"], update=False, together=["label"])
    for batch in (0, 1, 2, 0):
        stored.import_versions(docs.where(F.col("doc_id") % 3 == batch), batch, "label", "version", "doc_id", "content_hash")
    return stored.read()


STORED_VERSIONS = """
WITH f AS (SELECT source AS label, sha256(text) AS content_hash, doc_id, doc_id % 3 AS batch FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id % 3, doc_id) = 1)
SELECT label, content_hash, doc_id, row_number() OVER (PARTITION BY label ORDER BY batch, doc_id, content_hash) AS version FROM f"""

EVIDENCE = """(VALUES (1, 0, 'EXPLICIT', 'CONFIRMED', 'JOB', 'Pays well', 'Pays well'), (1, 1, 'DERIVED', 'CONFIRMED', 'JOB', 'x', 'y'), (1, 2, 'EXPLICIT', 'WEAK', 'JOB', 'x', 'y'), (1, 3, 'EXPLICIT', 'STRONG_EVIDENCE', 'USER_PROFILE', 'x', 'y'),
  (1, 4, 'EXPLICIT', 'STRONG_EVIDENCE', 'JOB', 'Remote', 'Fully remote'), (2, 0, 'EXPLICIT', 'CONFIRMED', 'JOB', '  ', 'y'), (2, 1, 'EXPLICIT', 'CONFIRMED', 'JOB', 'Team', NULL)) AS t(evaluation_id, pos, origin, level, kind, claim, excerpt)"""

EVIDENCE_ROWS = Rows(EVIDENCE, "events", {
    "evaluation_id": "1000 + user_id", "pos": "event_id", "origin": pick("event_id", "EXPLICIT", "EXPLICIT", "EXPLICIT", "DERIVED"), "level": pick("event_id", "CONFIRMED", "STRONG_EVIDENCE", "WEAK", "CONFIRMED", None),
    "kind": pick("event_id", "JOB", "JOB", "USER_PROFILE"), "claim": "CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(event_type, ' ', event_id % 13) END", "excerpt": "CASE WHEN event_id % 4 = 1 THEN concat(event_type, ' ', event_id % 13) WHEN event_id % 4 = 2 THEN props END",
})


def affirmative_facts(spark, folder):
    return evidence.compact(evidence.affirmative(EVIDENCE_ROWS.frame(spark, folder))).select("evaluation_id", "idx", "claim", "excerpt")


AFFIRMATIVE_FACTS = f"""SELECT evaluation_id, CAST(row_number() OVER (PARTITION BY evaluation_id ORDER BY pos) - 1 AS INTEGER) AS idx, claim, nullif(excerpt, claim) AS excerpt
FROM {EVIDENCE_ROWS.sql()} WHERE origin = 'EXPLICIT' AND level IN ('CONFIRMED', 'STRONG_EVIDENCE') AND kind <> 'USER_PROFILE' AND trim(claim) <> ''"""

REFS = "(VALUES (1, 'a,b', 'b,c;x'), (2, 'c', 'a'), (3, 'a,a', ''), (4, '', 'a')) AS t(id, refs, others)"

REF_ROWS = Rows(REFS, "events", {
    "id": "1000 + event_id", "refs": pick("event_id", "a", "a,b", "", "c,a,b", "b,b", "a,a,c"), "others": pick("user_id", "", "c", "b;c,d", "a,b;x", "d,d", "x;y;z", "b,a;a"),
})


def _refs(spark, folder):
    words = lambda x: F.filter(F.split(x, ","), lambda s: s != "")
    return REF_ROWS.frame(spark, folder).select("id", words(F.col("refs")).alias("refs"), words(F.regexp_replace("others", ";", ",")).alias("flat"), F.transform(F.split("others", ";"), words).alias("groups"))


def reference_checks(spark, folder):
    """Stored ids, overlap with contradictions, single-sided support and disjointness of reference lists."""
    ids = F.create_map(*(F.lit(x) for k, v in (("a", "id-1"), ("b", "id-2")) for x in (k, v)))
    refs = F.col("refs")
    return _refs(spark, folder).select(
        "id", F.array_join(evidence.resolved(refs, ids), ",", "?").alias("ids"), evidence.overlaps(refs, F.col("groups")).alias("contradicted"),
        evidence.only_from(refs, F.array(F.lit("a"))).alias("only_a"), evidence.partition_problem(refs, F.col("flat")).alias("problem"),
    )


REFERENCE_CHECKS = f"""
WITH t AS (SELECT id, list_filter(string_split(refs, ','), lambda s: s <> '') AS r, list_filter(string_split(replace(others, ';', ','), ','), lambda s: s <> '') AS f FROM {REF_ROWS.sql()})
SELECT id, coalesce(array_to_string(list_transform(r, lambda x: CASE x WHEN 'a' THEN 'id-1' WHEN 'b' THEN 'id-2' ELSE '?' END), ','), '') AS ids, list_has_any(r, f) AS contradicted,
  len(r) > 0 AND len(list_filter(r, lambda x: x <> 'a')) = 0 AS only_a,
  CASE WHEN len(list_distinct(r)) <> len(r) THEN 'duplicate_in_first' WHEN len(list_distinct(f)) <> len(f) THEN 'duplicate_in_second' WHEN list_has_any(r, f) THEN 'in_both' END AS problem FROM t"""


def issue_list(spark, folder):
    """Every user's distinct event values as issues: the first eight and how many more."""
    found = table(spark, folder, "events").select("user_id", F.floor("value").cast("string").alias("issue")).distinct()
    return evidence.first_issues(found, "user_id", "issue").select("user_id", "message")


ISSUE_LIST = """
WITH d AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS n FROM (SELECT DISTINCT user_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events))
SELECT user_id, string_agg(v, '; ' ORDER BY n) FILTER (n <= 8) || CASE WHEN count(*) > 8 THEN ' (+' || (count(*) - 8) || ' more)' ELSE '' END AS message FROM d GROUP BY 1"""

USAGES = """(VALUES (1, '{"usage":{"input":10,"details":{"cached":2}}}'), (2, '{"usage":{"input":-1}}'), (3, '{"usage":{"input":1.5}}'), (4, '{"usage":{"input":"x"}}'), (5, '{}'), (6, '{"usage":{"input":0,"details":{"cached":0}}}')) AS t(id, body)"""

USAGE_ROWS = Rows(USAGES, "events", {
    "id": "1000 + event_id", "body": """CASE event_id % 5 WHEN 0 THEN concat('{"usage":{"input":', event_id, ',"details":{"cached":', event_id % 7, '}}}') WHEN 1 THEN concat('{"usage":{"input":-', event_id, '}}')
      WHEN 2 THEN concat('{"usage":{"input":', event_id, '.5,"details":{"cached":"', event_type, '"}}}') WHEN 3 THEN concat('{"usage":{"details":{"cached":', user_id, '}}}') ELSE props END""",
})


def token_validity(spark, folder):
    part = lambda path: c.token_count(F.get_json_object("body", path))
    return USAGE_ROWS.frame(spark, folder).select("id", part("$.usage.input").alias("tokens_in"), part("$.usage.details.cached").alias("cached"))


_VALID = lambda path: f"CASE WHEN TRY_CAST(json_extract_string(body, '{path}') AS DOUBLE) >= 0 AND TRY_CAST(json_extract_string(body, '{path}') AS DOUBLE) = floor(TRY_CAST(json_extract_string(body, '{path}') AS DOUBLE)) THEN CAST(TRY_CAST(json_extract_string(body, '{path}') AS DOUBLE) AS BIGINT) END"
TOKEN_VALIDITY = f"SELECT id, {_VALID('$.usage.input')} AS tokens_in, {_VALID('$.usage.details.cached')} AS cached FROM {USAGE_ROWS.sql()}"


def canonical_hash(spark, folder):
    """A profile with nested objects, lists, maps and nulls, whose keys come in any order."""
    some = F.when(F.col("p_size") > 25, F.col("p_size"))
    content = F.struct(
        F.col("p_name").alias("name"), F.struct(some.alias("size"), F.col("p_brand").alias("brand")).alias("details"), F.array(F.struct(F.lit(2).alias("b"), some.alias("a"))).alias("list"),
        F.create_map(F.lit("z"), "p_name", F.lit("k"), "p_brand").alias("by_key"),
    )
    rows = table(spark, folder, "part").select("p_partkey", content.alias("content"))
    return rows.select("p_partkey", evidence.content_hash(F.col("content"), rows.schema["content"].dataType).alias("content_hash"))


CANONICAL_HASH = """SELECT p_partkey, sha256(CAST(to_json({'by_key': {'k': p_brand, 'z': p_name}, 'details': {'brand': p_brand, 'size': large}, 'list': [{'a': large, 'b': 2}], 'name': p_name}) AS VARCHAR)) AS content_hash
FROM (SELECT *, CASE WHEN p_size > 25 THEN p_size END AS large FROM part)"""

AREAS = "(VALUES (1, 'RENEWAL', 'PRIMARY', 2), (1, 'SUPPORT', 'NONE', 0), (2, 'RENEWAL', 'SUBSTANTIAL', 0), (3, 'RENEWAL', 'MINOR', 3)) AS t(id, area, share, n_refs)"


#: A user's events of one kind are an area of work: its share and evidence by how many there are.
_AREA = {"id": "1000 + user_id", "area": "CASE event_type WHEN 'click' THEN 'RENEWAL' WHEN 'view' THEN 'SUPPORT' ELSE upper(event_type) END", "share": pick("n", "PRIMARY", "NONE", "SUBSTANTIAL", "MINOR"), "n_refs": "n % 3"}


def renewal_support(spark, folder):
    """A list of entries as a map; renewal work counts with a large enough share and evidence for it."""
    events = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).selectExpr(*(f"{e} AS {k}" for k, e in _AREA.items()))
    rows = spark.sql(f"SELECT * FROM {AREAS}").unionByName(events)
    maps = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("area", F.struct("share", "n_refs")))).alias("areas"))
    renewal = F.col("areas")["RENEWAL"]
    return maps.select("id", F.size("areas").alias("n_areas"), (renewal["share"].isin("PRIMARY", "SUBSTANTIAL") & (renewal["n_refs"] > 0)).alias("supported"))


RENEWAL_SUPPORT = f"""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT * FROM {AREAS} UNION ALL BY NAME SELECT {', '.join(f'{e} AS {k}' for k, e in _AREA.items())} FROM e)
SELECT id, CAST(count(*) AS INTEGER) AS n_areas, CASE WHEN count(*) FILTER (area = 'RENEWAL') > 0 THEN bool_or(area = 'RENEWAL' AND share IN ('PRIMARY', 'SUBSTANTIAL') AND n_refs > 0) END AS supported FROM a GROUP BY 1"""

ERRORS = "(VALUES (1, 'P2002', 'weird id!/x'), (2, 'P1001', 'ok_id'), (3, 'P2034', ''), (4, 'other', 'é'), (5, 'P2003', 'a'), (6, 'P2011', 'b'), (7, 'P2000', 'c'), (8, 'P2028', 'd'), (9, 'P2002x', 'e'), (10, CAST(NULL AS VARCHAR(9)), 'f')) AS t(id, code, name)"
# Exact codes, then a prefix.
ERROR_CLASSES = [("P2002", "UNIQUE_CONSTRAINT"), ("P2003", "FOREIGN_KEY_CONSTRAINT"), ("P2011", "NULL_CONSTRAINT"), ("P2000", "VALUE_CONSTRAINT"), ("P2028", "TRANSACTION_FAILURE")]

ERROR_ROWS = Rows(ERRORS, "orders", {
    "id": "1000 + o_orderkey", "code": pick("o_orderkey", "P2002", "P2003", "P1017", "P2011", "P20", "p1001", "P2028", None, "P2000", "P2024", "E1"), "name": "concat(o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' /é.' ELSE '' END, o_custkey)",
})


def error_classes(spark, folder):
    code = F.col("code")
    named = rules.first_error([*((name, code == own) for own, name in ERROR_CLASSES), ("DATABASE_UNAVAILABLE", code.startswith("P1"))])
    return ERROR_ROWS.frame(spark, folder).select("id", F.coalesce(named, F.lit("UNKNOWN_DATABASE_ERROR")).alias("category"), c.identifier(F.col("name")).alias("name"))


ERROR_CLASSES_SQL = f"SELECT id, CASE code WHEN 'P2002' THEN 'UNIQUE_CONSTRAINT' WHEN 'P2003' THEN 'FOREIGN_KEY_CONSTRAINT' WHEN 'P2011' THEN 'NULL_CONSTRAINT' WHEN 'P2000' THEN 'VALUE_CONSTRAINT' WHEN 'P2028' THEN 'TRANSACTION_FAILURE' ELSE CASE WHEN starts_with(code, 'P1') THEN 'DATABASE_UNAVAILABLE' ELSE 'UNKNOWN_DATABASE_ERROR' END END AS category, substring(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), 1, 64) AS name FROM {ERROR_ROWS.sql()}"



def provider_errors(spark, folder):
    """What is told of events as a provider's errors, and where in a result an issue is."""
    status = F.element_at(F.array(*map(F.lit, [400, 429, 503])), (F.col("event_id") % 3 + 1).cast("int"))
    code = F.when(F.col("event_id") % 4 > 0, F.col("event_type")).otherwise(F.concat(F.col("event_type"), F.lit(" !")))
    param = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("items["), F.col("event_id") % 7, F.lit("]"))).when(F.col("event_id") % 5 == 1, F.col("props"))
    kind = F.when(F.col("event_id") % 6 == 0, F.repeat(F.lit("x"), F.lit(65))).when(F.col("event_id") % 6 == 1, F.lit("type.a"))
    segment = lambda name, index: F.struct(name.cast("string").alias("name"), index.cast("int").alias("index"))
    path = F.array(segment(F.when(F.col("event_id") % 8 > 0, F.concat(F.col("event_type"), F.lit(" é"))).otherwise(""), F.lit(None)), segment(F.lit(None), F.col("event_id") % 3), segment(F.lit("ok-name"), F.lit(None)))
    return table(spark, folder, "events").select("event_id", c.provider_message(status, code, param, kind).alias("message"), c.issue_path(path).alias("path"))


PROVIDER_ERRORS = """
WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'The semantic provider rejected the request' WHEN 1 THEN 'The semantic provider rate limit was reached' ELSE 'The semantic provider is temporarily unavailable' END AS said,
  concat_ws(', ', CASE WHEN event_id % 4 > 0 THEN 'code=' || event_type END, CASE WHEN event_id % 5 = 0 THEN 'param=items[' || (event_id % 7) || ']' END, CASE WHEN event_id % 6 = 1 THEN 'type=type.a' END) AS fields,
  '$.' || CASE WHEN event_id % 8 > 0 THEN event_type || '__' ELSE 'field' END || '[' || (event_id % 3) || '].ok-name' AS path FROM events)
SELECT event_id, CASE WHEN fields = '' THEN said ELSE said || ' (provider ' || fields || ')' END AS message, path FROM e"""


def selected_evidence(spark, folder):
    """The evidence (parts up to size 25) that each order's lines cite, once each in the order of the lines, and what is missing."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("reference"))
    parts = table(spark, folder, "part").where("p_size <= 25").select(F.col("p_partkey").alias("reference"), "p_name", "p_brand")
    return evidence.selected(lines, parts, "l_orderkey")


SELECTED_EVIDENCE = """
WITH f AS (SELECT l_orderkey, l_partkey AS reference, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
SELECT reference, l_orderkey, p_name, p_brand, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, reference) - 1 AS INTEGER) AS nth, p_partkey IS NULL AS missing
FROM f LEFT JOIN part ON p_partkey = reference AND p_size <= 25"""


def both_sides(spark, folder):
    """Scores, seniority and advice on positioning need evidence from the job and from the profile: which side a claim lacks."""
    claim = F.element_at(F.array(*map(F.lit, ["score", "seniority", "positioning"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", claim.alias("claim"), F.col("l_partkey").alias("p_partkey"))
    side = F.when(F.col("p_size") % 2 == 0, "USER_PROFILE").otherwise("JOB_DESCRIPTION")
    parts = table(spark, folder, "part").where("p_size > 5").select("p_partkey", side.alias("side"))
    return evidence.one_sided(lines.join(parts, "p_partkey", "left"), ["l_orderkey", "claim"], "USER_PROFILE")


BOTH_SIDES = """
WITH r AS (SELECT l_orderkey, ['score', 'seniority', 'positioning'][l_linenumber % 3 + 1] AS claim, coalesce(p_size % 2 = 0, false) AS own FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5)
SELECT l_orderkey, claim, CASE WHEN NOT bool_or(own) THEN 'profile' ELSE 'job' END AS missing FROM r GROUP BY 1, 2 HAVING NOT bool_or(own) OR bool_and(own)"""

STAGE_ROWS = "(VALUES (1, 'RUNNING', 1, 3, true), (2, 'FAILED', 1, 3, true), (3, 'FAILED', 3, 3, true), (4, 'FAILED', 1, 3, false), (5, 'COMPLETED', 1, 3, true), (6, 'PENDING', 0, 3, true)) AS t(id, status, attempt, max_attempts, retryable)"

STAGE_TABLE = Rows(STAGE_ROWS, "orders", {
    "id": "1000 + o_orderkey", "status": pick("o_orderkey", "RUNNING", "FAILED", "COMPLETED", "PENDING", "FAILED"), "attempt": "CAST(o_custkey % 4 AS INTEGER)", "max_attempts": "3", "retryable": "o_custkey % 5 <> 0",
})


def stage_transition(spark, folder):
    """Interrupted stages fail; a stage begins when it is pending, or failed with a retry left."""
    repaired = F.when(F.col("status") == "RUNNING", "FAILED").otherwise(F.col("status"))
    begins = (repaired == "PENDING") | ((repaired == "FAILED") & F.col("retryable") & (F.col("attempt") < F.col("max_attempts")))
    return STAGE_TABLE.frame(spark, folder).select("id", F.when(begins, "RUNNING").otherwise(repaired).alias("status"), (F.col("attempt") + begins.cast("int")).alias("attempt"), (repaired == "COMPLETED").alias("skipped"))


STAGE_TRANSITION = f"""
WITH t AS (SELECT *, CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS now FROM {STAGE_TABLE.sql()}), b AS (SELECT *, now = 'PENDING' OR (now = 'FAILED' AND retryable AND attempt < max_attempts) AS begins FROM t)
SELECT id, CASE WHEN begins THEN 'RUNNING' ELSE now END AS status, attempt + CAST(begins AS INTEGER) AS attempt, now = 'COMPLETED' AS skipped FROM b"""

#: The nine fields of a requirement that an assessment copies, each with a value that differs.
COPIED = {
    "requirement": ("concat('requirement ', l_partkey)", "'altered'"), "category": (pick("l_suppkey", "EXPERIENCE", "TOOL", "INDUSTRY"), "'LANGUAGE'"), "strength": (pick("l_partkey", "REQUIRED", "PREFERRED"), "'UNKNOWN'"),
    "years": ("CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 12 END", "-1"), "most": ("CASE WHEN l_partkey % 4 = 0 THEN 15 END", "16"), "open_ended": ("l_linenumber > 3", "NOT (l_linenumber > 3)"),
    "specificity": (pick("l_orderkey", "DIRECT", "RELATED", None), "'OTHER'"), "is_ambiguous": ("l_partkey % 6 = 0", "NOT (l_partkey % 6 = 0)"), "ambiguity": ("CASE WHEN l_partkey % 6 = 0 THEN 'unclear' END", "'altered'"),
}
_SAME = "'text', 'TOOL', 'REQUIRED', 3, NULL, true, 'DIRECT', false, CAST(NULL AS VARCHAR(9))"
COPIES = f"(VALUES (1, {_SAME}, {_SAME}), (2, {_SAME}, {_SAME.replace('NULL, true', '5, true')}), (3, {_SAME}, {_SAME.replace('text', 'Text').replace('3', 'NULL')})) AS t(id, {', '.join(COPIED)}, {', '.join(f'{k}_copy' for k in COPIED)})"
#: Of every twenty lines nine have one field altered, one two.
COPY_ROWS = Rows(COPIES, "lineitem", {"id": "1000 + l_orderkey", **{k: e for k, (e, _) in COPIED.items()}, **{f"{k}_copy": f"CASE WHEN l_partkey % 20 = {n} OR (l_partkey % 20 = 9 AND {n} IN (2, 6)) THEN {other} ELSE {e} END" for n, (k, (e, other)) in enumerate(COPIED.items())}})


def requirement_fidelity(spark, folder):
    """All nine copied fields must equal the source, nulls included; which don't."""
    altered = F.array_compact(F.array(*(F.when(~F.col(k).eqNullSafe(F.col(f"{k}_copy")), k) for k in COPIED)))
    return COPY_ROWS.frame(spark, folder).select("id", "requirement", (F.size(altered) == 0).alias("faithful"), F.array_join(altered, ",").alias("altered"))


REQUIREMENT_FIDELITY = f"""SELECT id, requirement, altered = '' AS faithful, altered FROM (SELECT id, requirement, concat_ws(',', {', '.join(f"CASE WHEN {k} IS DISTINCT FROM {k}_copy THEN '{k}' END" for k in COPIED)}) AS altered FROM {COPY_ROWS.sql()})"""

TIMINGS = "(VALUES (1, 'UNKNOWN', NULL, 0), (2, 'FRESH', 5, 1), (3, 'FRESH', NULL, 1), (4, 'UNKNOWN', 3, 0), (5, 'FRESH', 5, 0)) AS t(id, class, age, n_refs)"

TIMING_ROWS = Rows(TIMINGS, "orders", {"id": "1000 + o_orderkey", "class": pick("o_orderkey", "UNKNOWN", "FRESH", "STALE"), "age": "CASE WHEN o_custkey % 4 > 0 AND o_orderkey % 3 > 0 OR o_custkey % 9 = 0 THEN o_custkey % 60 END", "n_refs": "o_custkey % 3"})


def timing_rules(spark, folder):
    checks = rules.reasons([("unknown_means_no_age", (F.col("class") == "UNKNOWN") != F.col("age").isNull()), ("known_needs_evidence", (F.col("class") != "UNKNOWN") & (F.col("n_refs") == 0))])
    return TIMING_ROWS.frame(spark, folder).select("id", F.array_join(checks, ",").alias("violations"))


TIMING_RULES = f"SELECT id, concat_ws(',', CASE WHEN (class = 'UNKNOWN') <> (age IS NULL) THEN 'unknown_means_no_age' END, CASE WHEN class <> 'UNKNOWN' AND n_refs = 0 THEN 'known_needs_evidence' END) AS violations FROM {TIMING_ROWS.sql()}"

NAMES = (
    "detail_children evaluation_create lifecycle_change pruned_lookup backfill recommendation_upsert stored_upsert stored_versions affirmative_facts reference_checks issue_list token_validity canonical_hash renewal_support "
    "stage_transition requirement_fidelity timing_rules provider_errors selected_evidence both_sides"
).split()
QUERIES = {n: globals()[n] for n in NAMES} | {"error_classes": error_classes}
ORACLES = {n: globals()[n.upper()] for n in NAMES} | {"error_classes": ERROR_CLASSES_SQL}
