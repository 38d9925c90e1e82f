"""Queries over what is loaded, written and checked around an evaluation. Parts stand for raw records, orders for opportunities
and evaluations, lines for sources, stages and evidence, customers for companies and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievework.functions import facts
from sievework.operators import json_trees
from sievework.operators import opportunities as op
from sievework.plans.case_queries import Rows, pick
from sievework.plans.gates import Gate
from sievework.sources.shared import shared_folder
from sievework.sources.tables import table

RAW = """(VALUES (1, ' Lead ', 'Acme', NULL, '$60k', 'cs', 'Text  kept ', '2026-02-28', 'https://a.b/c', NULL, 'MANUAL', 'Full-time '), (2, 'x', ' ', 'Lisbon', NULL, NULL, NULL, NULL, NULL, NULL, 'MANUAL', NULL),
  (3, NULL, NULL, NULL, ' ', NULL, 'y', '2026-02-30', NULL, NULL, 'MANUAL', NULL), (4, 'x', 'y', 'z', NULL, NULL, 'y', NULL, NULL, 'https://x.y', 'ATS', NULL)
) AS t(record_id, title, company, location, salary_text, domain, description, posting_date, source_url, application_url, source_type, employment_type)"""
RAW_ROWS = Rows(RAW, "part", {
    "record_id": "1000 + p_partkey", "title": "' ' || p_name", "company": pick("p_size", "'", "x ", "Acme", None), "location": pick("p_partkey", " ", "Lisbon", None), "salary_text": pick("p_size", None, "$70k ", ""), "domain": pick("p_partkey", "cs", "ops"),
    "description": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name || '  ' END", "posting_date": pick("p_partkey", "2024-02-29", None, "2023-02-29", "2023-12-31", "12/31/2023"), "source_url": pick("p_size", "https://a.b/c", None), "application_url": pick("p_partkey", None, "https://d.e"),
    "source_type": pick("p_partkey", "MANUAL", "MANUAL", "MANUAL", "MANUAL", "MANUAL", "MANUAL", "ATS"), "employment_type": pick("p_size", None, " Full-time"),
})


def _raw(spark, folder):
    return RAW_ROWS.frame(spark, folder).withColumns({
        "external_id": F.concat(F.lit("x"), "record_id"), "requisition_id": F.lit(None).cast("string"), "source": F.lit("manual"), "discovered_at": F.lit("2026-01-01").cast("date"),
    })


def normalized_opportunity(spark, folder):
    return op.normalized(_raw(spark, folder))


_TRIM = lambda x: f"nullif(trim({x}), '')"
_DATE = "CASE WHEN regexp_matches(posting_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(posting_date AS DATE) END"
_INVALID = f"CASE WHEN source_type <> 'MANUAL' THEN 'not_manual' WHEN description IS NULL THEN 'text_required' WHEN posting_date IS NOT NULL AND {_DATE} IS NULL THEN 'date_invalid' END"
NORMALIZED_OPPORTUNITY = f"""SELECT record_id, {_TRIM('domain')} AS domain, {_TRIM('title')} AS title, {_TRIM('location')} AS location, {_TRIM('salary_text')} AS salary_text, {_TRIM('employment_type')} AS employment_type, {_TRIM('company')} AS company_name,
  'x' || record_id AS external_listing_id, CAST(NULL AS VARCHAR) AS ats_requisition_id, source_url AS canonical_url, application_url, 'manual' AS original_source, DATE '2026-01-01' AS discovered_at, DATE '2026-01-01' AS first_seen_at, DATE '2026-01-01' AS last_seen_at,
  CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, {_DATE} AS posting_date, 'manual' AS source, source_type, description AS job_description, 'DISCOVERED' AS status,
  """ + ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in op.OPEN_TEXT) + f", {_INVALID} AS violation FROM {RAW_ROWS.sql()}"


def normalized_provenance(spark, folder):
    return op.provenance(_raw(spark, folder))


NORMALIZED_PROVENANCE = f"""
WITH r AS (SELECT *, {_INVALID} AS violation, {_DATE} AS date FROM {RAW_ROWS.sql()}),
f AS (SELECT record_id, unnest([{{'n': 0, 'f': 'jobDescription', 's': 'rawText', 'x': description, 'v': description}}, {{'n': 1, 'f': 'title', 's': 'title', 'x': title, 'v': {_TRIM('title')}}}, {{'n': 2, 'f': 'company.name', 's': 'company', 'x': company, 'v': {_TRIM('company')}}},
  {{'n': 3, 'f': 'location', 's': 'location', 'x': location, 'v': {_TRIM('location')}}}, {{'n': 4, 'f': 'salaryText', 's': 'compensationText', 'x': salary_text, 'v': {_TRIM('salary_text')}}}, {{'n': 5, 'f': 'domain', 's': 'domain', 'x': domain, 'v': {_TRIM('domain')}}},
  {{'n': 6, 'f': 'canonicalUrl', 's': 'sourceUrl', 'x': source_url, 'v': source_url}}, {{'n': 7, 'f': 'applicationUrl', 's': 'applicationUrl', 'x': application_url, 'v': application_url}},
  {{'n': 8, 'f': 'postingDate', 's': 'postingDate', 'x': posting_date, 'v': strftime(date, '%Y-%m-%d') || 'T00:00:00.000Z'}}]) AS p FROM r WHERE violation IS NULL)
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY p.n) - 1 AS INTEGER) AS position, p.f AS field, p.s AS source_field, CASE WHEN p.x = p.v THEN 'DIRECT' ELSE 'DETERMINISTIC' END AS kind, p.v AS value, p.x AS source_text,
  'manual-submission' AS source_reference FROM f WHERE p.x IS NOT NULL AND p.v IS NOT NULL"""


def normalized_sink(spark, folder):
    """Every third record is linked already; records of large keys are gone."""
    rows = op.normalized(_raw(spark, folder))
    known = rows.where("record_id % 11 <> 0").select("record_id", F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("old-"), "record_id")).alias("opportunity_id"), F.lit(True).alias("found"))
    return op.linked(known, rows)


NORMALIZED_SINK = f"""SELECT record_id, CASE WHEN v IS NULL THEN 'opportunity-' || record_id ELSE old END AS opportunity_id, CASE WHEN v IS NULL AND {_TRIM('company')} IS NOT NULL THEN 'company-' || record_id END AS company_id, v AS violation
FROM (SELECT *, coalesce({_INVALID}, CASE WHEN record_id % 11 = 0 THEN 'record_missing' WHEN old IS NOT NULL THEN 'already_linked' END) AS v
  FROM (SELECT *, CASE WHEN record_id % 3 = 0 AND record_id % 11 <> 0 THEN 'old-' || record_id END AS old FROM {RAW_ROWS.sql()}))"""


def subject_load(spark, folder):
    """Orders with their lines as sources; a profile is asked for two times in three, and now and then one that isn't there."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    subject = orders.select(F.col("o_orderkey").alias("opportunity_id"), F.col("o_custkey").alias("company_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("salary_max"))
    companies = customers.select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"))
    sources = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("opportunity_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("created_at"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("source_id"))
    asked = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END")
    profiles = customers.select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").alias("profile_version"))
    given = orders.select(F.col("o_orderkey").alias("opportunity_id"), asked.alias("profile_id"))
    out = op.subjects(op.flattened(subject, companies), sources, given, profiles)
    return out.select("opportunity_id", "company_name", "industry", "salary_max", "profile_id", "profile_version", F.array_join("sources", ",").alias("sources"))


SUBJECT_LOAD = """
WITH s AS (SELECT l_orderkey, string_agg(l_linenumber || '-' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS sources FROM lineitem GROUP BY 1),
g AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS asked FROM orders)
SELECT o_orderkey AS opportunity_id, c.c_name AS company_name, c.c_mktsegment AS industry, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS salary_max, asked AS profile_id, p.c_nationkey AS profile_version, sources
FROM g LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer p ON p.c_custkey = asked LEFT JOIN s ON l_orderkey = o_orderkey WHERE asked IS NULL OR p.c_custkey IS NOT NULL"""


def evaluation_snapshot(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "evaluation_id")
    evaluations = table(spark, folder, "orders").select(F.col("o_orderkey").alias("evaluation_id"), "o_orderstatus")
    stages = lines.select("evaluation_id", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.concat_ws(":", "l_linenumber", "l_linestatus").alias("stage"))
    evidence = lines.select("evaluation_id", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("created_at"), F.concat(F.lit("ref-"), "l_partkey").alias("reference_id"))
    recommendations = evaluations.where("o_orderstatus = 'F'").select("evaluation_id", F.lit("REVIEW").alias("recommendation"))
    out = op.snapshots(evaluations, stages, evidence, recommendations)
    return out.select("evaluation_id", F.array_join("stages", ",").alias("stages"), F.array_join("evidence", ",").alias("evidence"), "recommendation")


EVALUATION_SNAPSHOT = """
WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS stages, string_agg('ref-' || l_partkey, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS evidence FROM lineitem GROUP BY 1)
SELECT o_orderkey AS evaluation_id, stages, evidence, CASE WHEN o_orderstatus = 'F' THEN 'REVIEW' END AS recommendation FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""


#: Lines that a task groups at a time, about; more lines make more tasks.
LINES = 1 << 18


def _parts(spark, folder):
    return table(spark, folder, "lineitem").count() // LINES + 1


def _outputs(spark, folder):
    """Stage outputs: a line is a piece of evidence, its part the source; a line with many pieces contradicts the next."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("stage_id"), "l_linenumber", "l_partkey", "l_quantity")
    lines = lines.repartition(_parts(spark, folder), "stage_id")
    drafts = lines.select("stage_id", F.concat(F.lit("ref-"), "l_linenumber").alias("reference_id"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("source_id")).distinct()
    ref = lambda n: F.array(F.concat(F.lit("ref-"), F.col("l_linenumber") + n))
    against = lines.where("l_quantity > 40").select("stage_id", F.col("l_linenumber").alias("position"), ref(0).alias("refs_a"), ref(1).alias("refs_b")).distinct()
    return drafts, against


def stage_complete(spark, folder):
    """Odd parts belong to opportunities with an odd key, even ones to those with an even key, but for every 50th."""
    stages = table(spark, folder, "orders").select(F.col("o_orderkey").alias("stage_id"), (F.col("o_orderkey") % 2).alias("opportunity_id"), F.when(F.col("o_orderstatus") == "F", "RUNNING").otherwise("PENDING").alias("status"))
    drafts, against = _outputs(spark, folder)
    own = F.expr("CASE WHEN source_id % 50 = 0 THEN NULL ELSE source_id END")
    drafts = drafts.withColumn("source_id", own)
    orders = stages.select("stage_id", "opportunity_id")
    sources = drafts.where("source_id % 10 <> 1").join(orders, "stage_id").select("source_id", "opportunity_id").distinct().groupBy("source_id").agg(F.min("opportunity_id").alias("opportunity_id"))
    out = op.completed(stages, drafts, sources, against)
    return out.select("stage_id", "status", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("contradictions", ",").alias("contradictions"), "violation")


STAGE_COMPLETE = """
WITH s AS (SELECT o_orderkey AS id, o_orderkey % 2 AS op, CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' ELSE 'PENDING' END AS status FROM orders),
d AS (SELECT DISTINCT l_orderkey AS id, 'ref-' || l_linenumber AS ref, CASE WHEN l_partkey % 4 <> 0 AND l_partkey % 50 <> 0 THEN l_partkey END AS src FROM lineitem),
o AS (SELECT src, min(op) AS owner FROM d JOIN s ON s.id = d.id WHERE src % 10 <> 1 GROUP BY 1),
e AS (SELECT d.id, bool_or(src IS NOT NULL AND owner IS DISTINCT FROM op) AS foreign_, string_agg(DISTINCT d.id || ':' || ref, ',' ORDER BY d.id || ':' || ref) AS ids FROM d JOIN s ON s.id = d.id LEFT JOIN o USING (src) GROUP BY 1),
c AS (SELECT id, string_agg(pair, ',' ORDER BY n) AS pairs FROM (SELECT DISTINCT l_orderkey AS id, l_linenumber AS n, l_orderkey || ':ref-' || l_linenumber || '|' || l_orderkey || ':ref-' || (l_linenumber + 1) AS pair FROM lineitem WHERE l_quantity > 40) GROUP BY 1),
v AS (SELECT s.*, ids, pairs, CASE WHEN status <> 'RUNNING' THEN 'invalid_stage_state' WHEN coalesce(foreign_, false) THEN 'foreign_source' END AS violation FROM s LEFT JOIN e ON e.id = s.id LEFT JOIN c ON c.id = s.id)
SELECT id AS stage_id, CASE WHEN violation IS NULL THEN 'COMPLETED' ELSE status END AS status, CASE WHEN violation IS NULL THEN coalesce(ids, '') END AS evidence_ids, CASE WHEN violation IS NULL THEN coalesce(pairs, '') END AS contradictions, violation FROM v"""


def output_contract(spark, folder):
    drafts, against = _outputs(spark, folder)
    return op.contract_violations(drafts.select("stage_id", "reference_id").unionByName(drafts.where("source_id % 9 = 0").select("stage_id", "reference_id")), against, _parts(spark, folder))


OUTPUT_CONTRACT = """
WITH d AS (SELECT DISTINCT l_orderkey AS id, 'ref-' || l_linenumber AS ref, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS src FROM lineitem), a AS (SELECT id, ref FROM d UNION ALL SELECT id, ref FROM d WHERE src % 9 = 0),
c AS (SELECT DISTINCT l_orderkey AS id, 'ref-' || (l_linenumber + x) AS ref FROM lineitem CROSS JOIN (VALUES (0), (1)) AS t(x) WHERE l_quantity > 40)
SELECT id AS stage_id, 'duplicate_reference' AS rule, ref AS reference_id FROM a GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT id, 'unknown_reference', ref FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = c.id AND d.ref = c.ref)"""

POSTINGS = """(VALUES (1, '$60k - $70k', 'Remote', 'Up to 10% travel. Degree required.', CAST(NULL AS BIGINT)), (2, NULL, NULL, 'Competitive salary. Nothing else', NULL), (3, NULL, NULL, 'Pay: $80k – $95k. Hybrid work.', NULL), (4, NULL, '', 'No facts.', 50000)) AS t(id, salary_text, place, description, low)"""
POSTING_ROWS = Rows(POSTINGS, "documents", {"id": "1000 + doc_id", "salary_text": "CAST(NULL AS STRING)", "place": "CAST(NULL AS STRING)", "description": "text", "low": "CAST(NULL AS BIGINT)"})


def fact_evidence(spark, folder):
    """A row of evidence for each fact that a posting states."""
    out = facts.evidence_rows(POSTING_ROWS.frame(spark, folder))
    return out.select("id", "pos", "reference_id", "criterion", "claim", "source_field", F.md5("source_text").alias("source_text"))


def _fact_sql():
    from sievework.plans.case_queries import _amount, _group, quoted
    from sievework.plans.table_queries import _SPLIT
    from sievework.functions import patterns as p

    split = lambda x: _SPLIT.replace("regexp_replace(text,", f"regexp_replace({x},")
    lines = "string_split(regexp_replace(regexp_replace(description, '\\r?\\n', chr(1), 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))"
    bare = f"list_filter(list_transform({lines}, lambda y: regexp_replace(regexp_replace(y, '^[-*•]\\s*', ''), '^\\s+|\\s+$', '', 'g')), lambda y: length(y) >= 8 AND regexp_matches(y, '{quoted(p.REQUIREMENT)}', 'i'))"
    return f"""
WITH t AS (SELECT *, coalesce(salary_text, description) AS x, coalesce(place, '') || chr(10) || description AS y FROM {POSTING_ROWS.sql()}),
m AS (SELECT *, {_group('x', p.MONEY_RANGE, 0)} AS ranged, coalesce(low, CASE WHEN {_group('x', p.MONEY_RANGE, 0)} IS NOT NULL THEN {_amount(_group('x', p.MONEY_RANGE, 1), _group('x', p.MONEY_RANGE, 2))} ELSE {_amount(_group('x', p.MONEY, 1), _group('x', p.MONEY, 2))} END) AS minimum,
  CASE WHEN salary_text IS NULL THEN 'jobDescription' ELSE 'salaryText' END AS pay_field, list_filter({split('y')}, lambda z: regexp_matches(z, '{quoted(p.PLACE)}', 'i'))[1] AS place_line, list_filter({split('description')}, lambda z: regexp_matches(z, '{quoted(p.TRAVEL)}', 'i'))[1] AS travel_line FROM t),
r AS (SELECT id, 0 AS n, 'salary-competitive' AS reference_id, 'salary' AS criterion, 'The job describes compensation only as competitive.' AS claim, pay_field AS source_field, coalesce(salary_text, 'Competitive salary') AS s FROM m WHERE minimum IS NULL AND regexp_matches(x, '{quoted(p.COMPETITIVE)}', 'i')
UNION ALL SELECT id, 1, 'salary-disclosed', 'salary', 'The disclosed salary range begins at ' || minimum || '.', pay_field, coalesce(salary_text, nullif(ranged, ''), '$' || minimum) FROM m WHERE minimum IS NOT NULL
UNION ALL SELECT id, 2, 'location-facts', 'location', 'The job states location or work-arrangement information.', 'jobDescription', place_line FROM m WHERE place_line IS NOT NULL
UNION ALL SELECT id, 3, 'travel-facts', 'travel', 'The job states a travel expectation.', 'jobDescription', travel_line FROM m WHERE travel_line IS NOT NULL
UNION ALL SELECT id, 3 + k, 'requirement-' || k, 'candidate-requirement', 'The job states a candidate requirement.', 'jobDescription', q FROM (SELECT id, unnest(qs) AS q, generate_subscripts(qs, 1) AS k FROM (SELECT id, {bare} AS qs FROM m)))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS pos, reference_id, criterion, claim, source_field, md5(s) AS source_text FROM r"""


FACT_EVIDENCE = _fact_sql()

RESULTS = """(VALUES (1, '{"a":{"evidenceReferences":["jd-1", "profile-0"],"text":"about ' || chr(92) || '"evidenceReferences' || chr(92) || '": [' || chr(92) || '"jd-7' || chr(92) || '"]"},"jdEvidenceReferences":[]}'), (2, '{"x":[{"evidenceReferencesA":["jd-9"]}]}'), (3, '{"evidenceReferences":"jd-1"}'), (4, '{"evidenceReferences":["jd-1",3]}'), (5, '{"other":["jd-9"]}')) AS t(id, body)"""
RESULT_ROWS = Rows(RESULTS, "lineitem", {
    "id": "1000 + l_orderkey * 10 + l_linenumber", "body": """'{"stage":{"items":[{"jdEvidenceReferences":["jd-1"],"profileEvidenceReferences":["profile-0","' || """ + pick("l_partkey", "jd-1", "profile-0", "jd-3") + """ || '"]}],"note":"jd-1"},"evidenceReferencesB":["jd-1"],"n":' || l_partkey || '}'""",
})


def reference_rewrite(spark, folder):
    names = F.create_map(F.lit("jd-1"), F.lit("stored-a"), F.lit("profile-0"), F.lit("stored-b"))
    return RESULT_ROWS.frame(spark, folder).select("id", op.rewritten(F.col("body"), names).alias("r")).select("id", "r.*")


_KEYS = '"(?:evidenceReferences|jdEvidenceReferences|profileEvidenceReferences|decisionImpactReferences|assessmentOnlyReferences|evidenceReferencesA|evidenceReferencesB)"\\s*:\\s*'
_LISTS = _KEYS + '\\[\\s*(?:"(?:[^"\\\\]|\\\\.)*"\\s*(?:,\\s*"(?:[^"\\\\]|\\\\.)*"\\s*)*)?\\]'
REFERENCE_REWRITE = f"""
WITH t AS (SELECT id, body, string_split(regexp_replace(body, '({_LISTS})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps, len(regexp_extract_all(body, '{_KEYS}')) <> len(regexp_extract_all(body, '{_LISTS}')) AS malformed FROM {RESULT_ROWS.sql()}),
l AS (SELECT *, list_transform(ps, lambda p, i: CASE WHEN i % 2 = 0 THEN regexp_replace(regexp_replace(p, '"jd-1"', '"stored-a"', 'g'), '"profile-0"', '"stored-b"', 'g') ELSE p END) AS qs,
  list_bool_or(list_transform(ps, lambda p, i: i % 2 = 0 AND len(list_filter(regexp_extract_all(p, '"([^"]*)"', 1)[2:], lambda r: r NOT IN ('jd-1', 'profile-0'))) > 0)) AS lost FROM t)
SELECT id, CASE WHEN NOT malformed AND NOT lost THEN array_to_string(qs, '') END AS json, CASE WHEN malformed THEN 'malformed_references' WHEN lost THEN 'unknown_reference' END AS violation FROM l"""


def derived_evidence(spark, folder):
    """Lines as evidence of three origins; only the derived are handed on."""
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", pick("l_suppkey", "EXPLICIT", "DERIVED", "INFERRED") + " AS origin")
    return op.derived(lines)


DERIVED_EVIDENCE = "SELECT l_orderkey, l_linenumber, l_partkey, 'DERIVED' AS origin FROM lineitem WHERE l_suppkey % 3 = 1"

def canonical_json_hash(spark, folder):
    """Events as nested documents whose keys come in one of two orders, with one hash for both."""
    one = """concat('{"user":', user_id, ', "props":', props, ', "Kinds":["', event_type, '",{"z":null,"b":[],"a":{}}], "event":', event_id, '}')"""
    two = """concat('{"Kinds":["', event_type, '",{"a":{},"b":[],"z":null}],"event":', event_id, ',"props":', props, ',"user":', user_id, '}')"""
    docs = table(spark, folder, "events").selectExpr("event_id AS id", f"CASE WHEN event_id % 2 = 0 THEN {one} ELSE {two} END AS json")
    return json_trees.canonical_json(docs)


CANONICAL_JSON_HASH = """SELECT id, json, sha256(json) AS content_hash FROM (SELECT event_id AS id,
  concat('{"event":', event_id, ',"Kinds":["', event_type, '",{"a":{},"b":[],"z":null}],"props":{"k":', json_extract_string(props, '$.k'), '},"user":', user_id, '}') AS json FROM events)"""


def reference_walk(spark, folder):
    """References anywhere in nested results, by their stored names; some lists are malformed, some references unknown."""
    wrong = """CASE WHEN event_id % 50 = 0 THEN '"jd-1"' WHEN event_id % 50 = 1 THEN '["jd-0",[7]]' ELSE concat('["profile-', user_id % 3, '","jd-', event_id % 4, '"]') END"""
    body = f"""concat('{{"summary":"', event_type, ' \\\\"evidenceReferences\\\\":[\\\\"x\\\\"]","items":[{{"note":"[jd-1]","jdEvidenceReferences":["jd-', event_id % 4, '"]}},{{"deep":{{"evidenceReferences":', {wrong}, '}}}}]}}')"""
    docs = table(spark, folder, "events").selectExpr("event_id AS id", f"{body} AS json")
    names = spark.sql("SELECT * FROM VALUES ('jd-0', 'stored-a'), ('jd-1', 'stored-b'), ('jd-2', 'stored-c'), ('profile-0', 'own-a'), ('profile-1', 'own-b') AS t(reference, stored)")
    return json_trees.rewrite_references(docs, names, op.REFERENCE_KEYS)


REFERENCE_WALK = """
WITH t AS (SELECT event_id AS id, event_type, CASE event_id % 4 WHEN 0 THEN 'stored-a' WHEN 1 THEN 'stored-b' WHEN 2 THEN 'stored-c' END AS jd, CASE user_id % 3 WHEN 0 THEN 'own-a' WHEN 1 THEN 'own-b' END AS own, event_id % 50 < 2 AS malformed FROM events),
v AS (SELECT *, CASE WHEN malformed THEN 'malformed_references' WHEN jd IS NULL OR own IS NULL THEN 'unknown_reference' END AS violation FROM t)
SELECT id, CASE WHEN violation IS NULL THEN concat('{"items":[{"jdEvidenceReferences":["', jd, '"],"note":"[jd-1]"},{"deep":{"evidenceReferences":["', own, '","', jd, '"]}}],"summary":"', event_type, ' \\"evidenceReferences\\":[\\"x\\"]"}') END AS json, violation FROM v"""

def contract_gate(spark, folder):
    """Lines behind a gate, in one scan: those set aside, each with the first rule it breaks."""
    rules = {"quantity": F.col("l_quantity") > 45, "returned_early": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "discount": F.col("l_discount") >= 0.09}
    gate, path = Gate("lines", rules), f"{shared_folder(spark)}/sievework/gate-{uuid.uuid4().hex}"
    gate.passed(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount"), path)
    return gate.set_aside(spark, path).select("l_orderkey", "l_linenumber", "l_partkey", "violation")


CONTRACT_GATE = """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned_early' WHEN l_discount >= 0.09 THEN 'discount' END AS violation FROM lineitem) WHERE violation IS NOT NULL"""

NAMES = "normalized_opportunity normalized_provenance normalized_sink subject_load evaluation_snapshot stage_complete output_contract fact_evidence reference_rewrite derived_evidence canonical_json_hash reference_walk contract_gate".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
