"""Queries over small relations of boundary cases, written once and read by both engines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import columns as c
from sievework.functions import facts, rules
from sievework.functions import patterns as p
from sievework.operators import matching
from sievework.plans.table_queries import _SPLIT, cost_sql
from sievework.sources.tables import table


def cases(spark: SparkSession, relation: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {relation}")


@dataclass(frozen=True)
class Rows:
    """Boundary cases, then a row (or `where` some) of a whole table each; the expressions are read by both engines."""

    cases: str
    source: str
    columns: dict[str, str]
    where: str = "true"

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        more = table(spark, folder, self.source).where(self.where).selectExpr(*(f"{e} AS {n}" for n, e in self.columns.items()))
        return cases(spark, self.cases).unionByName(more)

    def sql(self, name: str = "t") -> str:
        more = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"(SELECT * FROM {self.cases.replace('STRING', 'VARCHAR')} UNION ALL BY NAME SELECT {more} FROM {self.source} WHERE {self.where}) AS {name}"


def pick(number: str, *values: str | None) -> str:
    """One of the values by a number."""
    shown = ("NULL" if v is None else v if v in ("true", "false") or v.isdigit() else f"'{quoted(v)}'" for v in values)
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(shown)) + " END"


def quoted(text: str) -> str:
    return text.replace("'", "''")


COSTS = """(VALUES (100, 25, 20, 2.0, 0.2, 12.0), (1000, 100, 500, 2.0, 0.2, 12.0), (1000, 100, 500, 0.2, 0.02, 1.2), (44830, 0, 6814, 2.0, 0.2, 12.0), (29087, 0, 6588, 2.0, 0.2, 12.0),
  (20560, 0, 6488, 2.0, 0.2, 12.0), (272000, 0, 10, 2.0, 0.2, 12.0), (272001, 1, 10, 2.0, 0.2, 12.0), (100, CAST(NULL AS INT), 5, 2.0, 0.2, 12.0), (10, 11, 5, 2.0, 0.2, 12.0)
) AS t(tokens_in, cached, out, price_input, price_cached, price_output)"""


COST_ROWS = Rows(COSTS, "lineitem", {
    "tokens_in": "l_partkey * 17", "cached": "CASE WHEN l_linenumber > 6 THEN NULL ELSE l_partkey * 3 END", "out": "l_suppkey", "price_input": "2.0", "price_cached": "0.2", "price_output": "12.0",
})


def cost_golden(spark, folder):
    price = {k: F.col(f"price_{k}") for k in ("input", "cached", "output")} | {"threshold": F.lit(272_000), "input_factor": F.lit(2.0), "output_factor": F.lit(1.5)}
    cost = c.operation_cost(F.col("tokens_in"), F.col("cached"), F.col("out"), price)
    rows = COST_ROWS.frame(spark, folder).select("tokens_in", "cached", "out", "price_input", cost.cast("double").alias("cost"))
    return rows.withColumn("price_input", F.col("price_input").cast("double"))


COST_GOLDEN = f"""SELECT tokens_in, cached, out, CAST(price_input AS DOUBLE) AS price_input, CAST({cost_sql('tokens_in', 'cached', 'out')} AS DOUBLE) AS cost
FROM (SELECT *, 272000 AS threshold, 2.0 AS input_factor, 1.5 AS output_factor FROM {COST_ROWS.sql()})"""

SALARIES = """(VALUES (1, '$60,000 - $80,000', 'x', CAST(NULL AS BIGINT)), (2, '$60k to $70k', 'x', NULL), (3, '$70-90k', 'x', NULL), (4, '$70000', 'x', NULL), (5, '$1,200', 'x', NULL), (6, NULL, 'We pay a competitive salary.', NULL),
  (7, NULL, 'Nothing about pay.', NULL), (8, '$55K', 'x', NULL), (9, 'around $ 54,999 a year', 'x', NULL), (10, NULL, 'Pay: $80k – $95k', 50000), (11, 'competitive pay', '$60k', NULL)
) AS t(id, salary_text, description, low)"""


SALARY_ROWS = Rows(SALARIES, "documents", {"id": "1000 + doc_id", "salary_text": "CAST(NULL AS STRING)", "description": "text", "low": "CAST(NULL AS BIGINT)"})


def salary_facts(spark, folder):
    none = F.lit(None)
    s = facts.salary(F.col("salary_text"), F.col("description"), F.col("low"), none.cast("bigint"), none.cast("string"))
    return SALARY_ROWS.frame(spark, folder).select("id", s.alias("s")).select("id", "s.*")


def _group(x: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({x}, '{quoted(pattern)}', {n}, 'i'), '')"


def _amount(digits: str, k: str) -> str:
    return f"CAST(replace({digits}, ',', '') AS BIGINT) * CASE WHEN {k} IS NULL THEN 1 ELSE 1000 END"


SALARY_FACTS = f"""
WITH t AS (SELECT *, coalesce(salary_text, description) AS x FROM {SALARY_ROWS.sql()}),
r AS (SELECT *, {_group('x', p.MONEY_RANGE, 0)} IS NOT NULL AS ranged FROM t),
m AS (SELECT *, coalesce(low, CASE WHEN ranged THEN {_amount(_group('x', p.MONEY_RANGE, 1), _group('x', p.MONEY_RANGE, 2))} ELSE {_amount(_group('x', p.MONEY, 1), _group('x', p.MONEY, 2))} END) AS minimum,
  CASE WHEN ranged THEN {_amount(_group('x', p.MONEY_RANGE, 3), _group('x', p.MONEY_RANGE, 4))} END AS top FROM r)
SELECT id, minimum, CASE WHEN minimum IS NOT NULL THEN coalesce(top, minimum) END AS maximum, CASE WHEN minimum IS NOT NULL THEN 'USD' END AS currency,
  CASE WHEN minimum IS NOT NULL THEN 'DISCLOSED' WHEN regexp_matches(x, '{quoted(p.COMPETITIVE)}', 'i') THEN 'COMPETITIVE' ELSE 'UNDISCLOSED' END AS disclosure FROM m"""

PLACES = """(VALUES (1, 'Remote', 'US only role in EST or PST hours, EST preferred.'), (2, 'Berlin', 'Hybrid, remote on Fridays. Relocation is available.'), (3, CAST(NULL AS STRING), 'On-site work. No visa sponsorship.'),
  (4, NULL, 'Remote. Work from anywhere in the world. Must reside in Canada or Mexico'), (5, '', 'Candidates located in Portugal. UTC+1. Visa sponsorship available via Deel.'), (6, NULL, 'Nothing is said.'),
  (7, 'Remote', 'must be based in the United States, worldwide team'), (8, NULL, 'must reside in canada; no relocation; In-Office')) AS t(id, place, description)"""
PLACE_ROWS = Rows(PLACES, "documents", {"id": "1000 + doc_id", "place": "CAST(NULL AS STRING)", "description": "text"})


def location_facts(spark, folder):
    return PLACE_ROWS.frame(spark, folder).select("id", facts.location(F.col("place"), F.col("description")).alias("s")).select("id", "s.*")


def _case(x: str, options: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{quoted(q)}', 'i') THEN '{n}'" for n, q in options) + f" ELSE '{default}' END"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{quoted(pattern)}', 'i')"


LOCATION_FACTS = f"""
WITH t AS (SELECT id, coalesce(place, '') || chr(10) || description AS x FROM {PLACE_ROWS.sql()}),
z AS (SELECT id, zone, min(pos) AS pos FROM (SELECT id, unnest(zones) AS zone, generate_subscripts(zones, 1) AS pos FROM (SELECT id, regexp_extract_all(x, '{p.TIME_ZONE}') AS zones FROM t)) GROUP BY 1, 2),
zones AS (SELECT id, string_agg(zone, ',' ORDER BY pos) AS zones FROM z GROUP BY 1)
SELECT t.id, {_case('x', [('HYBRID', p.HYBRID), ('ONSITE', p.ONSITE), ('REMOTE', p.REMOTE)], 'UNKNOWN')} AS arrangement,
  CASE WHEN {_has('x', p.US_ONLY)} THEN 'United States' ELSE trim(nullif(regexp_extract(x, '{p.COUNTRY}', 1), '')) END AS country, coalesce(zones, '') AS zones,
  CASE WHEN {_has('x', p.WORLDWIDE)} THEN 'EXPLICITLY_ALLOWED' WHEN {_has('x', p.US_ONLY)} THEN 'EXPLICITLY_NOT_ALLOWED' ELSE 'UNKNOWN' END AS eligibility,
  {_case('x', [('AVAILABLE', p.VISA_YES), ('NOT_AVAILABLE', p.VISA_NO)], 'UNKNOWN')} AS visa,
  {_case('x', [('AVAILABLE', p.RELOCATION_YES), ('REQUIRED', p.RELOCATION_MUST), ('NOT_AVAILABLE', p.RELOCATION_NO)], 'UNKNOWN')} AS relocation,
  {_case('x', [('AVAILABLE', p.EMPLOYER_OF_RECORD)], 'UNKNOWN')} AS employer_of_record FROM t LEFT JOIN zones ON zones.id = t.id"""

TRAVELS = """(VALUES (1, 'Up to 20% travel to customer sites monthly is required.'), (2, 'No travel.'), (3, 'Optional retreat once a year, infrequent travel.'), (4, 'Attend conference events, domestic and international.'), (5, CAST(NULL AS STRING)),
  (6, 'Territory travel weekly'), (7, 'This is an on-site job.'), (8, 'International travel must happen')) AS t(id, sentence)"""


TRAVEL_ROWS = Rows(TRAVELS, "documents", {"id": "1000 + doc_id", "sentence": "text"})


def travel_facts(spark, folder):
    """From the first sentence of a text that is about travel."""
    told = facts.first_matching_sentence(F.col("sentence"), p.TRAVEL)
    return TRAVEL_ROWS.frame(spark, folder).select("id", told.alias("told")).select("id", facts.travel(F.col("told")).alias("s")).select("id", "s.*")


TRAVEL_FACTS = f"""SELECT id, CASE WHEN x IS NULL THEN 'UNKNOWN' ELSE {_case('x', facts.PURPOSES, 'OTHER')} END AS purpose, CAST({_group('x', p.PERCENT, 1)} AS INTEGER) AS percentage,
  {_group('x', p.FREQUENCY, 1)} AS frequency, CASE WHEN x IS NULL THEN NULL WHEN {_has('x', p.NO_TRAVEL)} THEN false WHEN {_has('x', p.MANDATORY)} THEN true WHEN {_has('x', p.OPTIONAL)} THEN false END AS mandatory,
  CASE WHEN x IS NULL THEN 'UNKNOWN' ELSE {_case('x', facts.SCOPES, 'UNKNOWN')} END AS scope FROM (SELECT id, list_filter({_SPLIT.replace('regexp_replace(text,', 'regexp_replace(sentence,')}, lambda z: {_has('z', p.TRAVEL)})[1] AS x FROM {TRAVEL_ROWS.sql()})"""

POSTINGS = """(VALUES (1, '- 3-5+ years of experience required. Degree preferred. Short.'), (2, 'Salesforce is nice to have. You must have fluent German. 7+ years of experience in SaaS.'), (3, 'Nothing asked here at all.'),
  (4, 'Ideally you know data analytics. Travel required monthly.'), (5, 'First line here.
  - Indented bullet is required
- Customer success experience preferred')) AS t(id, description)"""
POSTING_ROWS = Rows(POSTINGS, "documents", {"id": "1000 + doc_id", "description": "text"})


def requirement_rows(spark, folder):
    rows = POSTING_ROWS.frame(spark, folder).select("id", F.posexplode(facts.requirements(F.col("description"))).alias("pos", "requirement"))
    return rows.select("id", F.concat(F.lit("requirement-"), F.col("pos") + 1).alias("reference_id"), "requirement", *facts.requirement(F.col("requirement")))


REQUIREMENT_ROWS = f"""
WITH s AS (SELECT id, unnest(parts) AS y, generate_subscripts(parts, 1) AS n FROM (SELECT id, string_split(regexp_replace(regexp_replace(description, '\\r?\\n', chr(1), 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {POSTING_ROWS.sql()})),
b AS (SELECT id, n, regexp_replace(regexp_replace(y, '^[-*•]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS x FROM s),
k AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY n) AS nth FROM b WHERE length(x) >= 8 AND {_has('x', p.REQUIREMENT)})
SELECT id, 'requirement-' || nth AS reference_id, x AS requirement, {_case('x', p.CATEGORIES, 'CAPABILITY')} AS category, {_case('x', p.STRENGTHS, 'AMBIGUOUS')} AS strength,
  CASE WHEN regexp_matches(x, 'customer success', 'i') THEN 'Customer Success' WHEN regexp_matches(x, 'experience', 'i') THEN 'Experience area stated in source text' END AS specificity,
  NOT regexp_matches(x, 'nice to have|\\b(?:preferred|ideal|ideally|required|must have)\\b', 'i') AS ambiguous,
  CASE WHEN NOT regexp_matches(x, 'nice to have|\\b(?:preferred|ideal|ideally|required|must have)\\b', 'i') THEN 'The source states experience but does not label its strength.' END AS ambiguity,
  CAST(coalesce({_group('x', p.YEARS_RANGE, 1)}, {_group('x', p.YEARS, 1)}) AS INTEGER) AS years, CAST({_group('x', p.YEARS_RANGE, 2)} AS INTEGER) AS years_most,
  coalesce({_group('x', p.YEARS_RANGE, 3)}, {_group('x', p.YEARS, 2)}) IS NOT NULL AS open_ended FROM k"""

FACTS = """(VALUES (1, 'DISCLOSED', 60000, 60000, false, false, 'Canada', 'REMOTE', 'NONE', 'rare', 'CORE_CS'), (2, 'DISCLOSED', 59999, 59999, true, false, 'United States', 'REMOTE', 'CUSTOMER_ONSITE', 'monthly', 'CORE_CS'),
  (3, 'DISCLOSED', 54999, 54999, true, false, 'United States', 'HYBRID', 'COMPANY_EVENT', 'infrequent', 'CORE_CS'), (4, 'DISCLOSED', 50000, 52000, false, false, 'Portugal', 'UNKNOWN', 'COMPANY_EVENT', 'annual', 'CORE_CS'),
  (5, 'COMPETITIVE', NULL, NULL, false, true, NULL, 'REMOTE', 'UNKNOWN', NULL, 'UNRELATED'), (6, 'DISCLOSED', 50000, 56000, false, true, NULL, 'ONSITE', 'FIELD_TRAVEL', NULL, 'CORE_CS'),
  (7, 'DISCLOSED', 40000, 45000, false, false, 'Russia', 'REMOTE', 'CUSTOMER_ONSITE', 'rare', 'CORE_CS'), (8, 'DISCLOSED', 40000, 45000, false, true, 'France', 'REMOTE', 'OTHER', NULL, 'CORE_CS'), (9, 'UNDISCLOSED', NULL, NULL, false, false, NULL, 'REMOTE', 'CONFERENCE', 'frequent', 'CORE_CS')
) AS t(id, disclosure, low, high, us_required, eligible, country, arrangement, purpose, frequency, role)"""
FACT_ROWS = Rows(FACTS, "orders", {
    "id": "1000 + o_orderkey", "disclosure": pick("o_orderkey", "DISCLOSED", "DISCLOSED", "COMPETITIVE", "DISCLOSED", "UNDISCLOSED"), "low": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 40000 + o_custkey % 30000 END",
    "high": "42000 + o_custkey % 40000", "us_required": "o_orderkey % 3 = 0", "eligible": "o_orderkey % 4 = 1", "country": pick("o_custkey", "Canada", "United States", "Portugal", "Russia", None, "France", "mexico"),
    "arrangement": pick("o_orderkey + o_custkey", "REMOTE", "HYBRID", "UNKNOWN", "ONSITE", "REMOTE"), "purpose": pick("o_orderkey", "NONE", "CUSTOMER_ONSITE", "COMPANY_EVENT", "CONFERENCE", "FIELD_TRAVEL", "OTHER", "UNKNOWN"),
    "frequency": pick("o_custkey", None, "monthly", "rare", "infrequent", "annual"), "role": pick("o_custkey", "CORE_CS", "CS_ADJACENT", "UNRELATED", "TECHNICAL_CS"),
})
CHEAPER, BANNED, ACCEPTED = ["Portugal", "Mexico"], ["Russia"], ["United States", "Canada", "Portugal"]


def _criteria(df: DataFrame) -> DataFrame:
    x = F.col
    return df.withColumns({
        "salary": rules.salary_criterion(x("disclosure"), x("low"), x("high"), x("us_required"), x("eligible"), x("country"), CHEAPER),
        "location": rules.location_criterion(x("country"), x("eligible"), BANNED, ACCEPTED, True),
        "work": rules.arrangement_criterion(x("arrangement"), ["REMOTE"], "REVIEW"),
        "travel": rules.travel_criterion(x("purpose"), x("frequency"), True, True),
        "role_fit": rules.role_criterion(x("role")),
    })


NAMED = ["salary", "location", "work", "travel", "role_fit"]


def hard_filter_criteria(spark, folder):
    return _criteria(FACT_ROWS.frame(spark, folder)).select("id", *NAMED)


CRITERIA = f"""(SELECT *, CASE WHEN disclosure <> 'DISCLOSED' OR low IS NULL THEN 'UNKNOWN' WHEN low >= 60000 THEN 'PASS' WHEN low >= 55000 OR high >= 55000 THEN 'REVIEW' WHEN us_required THEN 'FAIL'
    WHEN eligible OR coalesce(lower(country) IN ('portugal', 'mexico'), false) THEN 'PASS' ELSE 'REVIEW' END AS salary,
  CASE WHEN lower(country) = 'russia' OR (country IS NOT NULL AND lower(country) NOT IN ('united states', 'canada', 'portugal')) THEN 'FAIL' WHEN country IS NULL AND NOT eligible THEN 'UNKNOWN' ELSE 'PASS' END AS location,
  CASE arrangement WHEN 'UNKNOWN' THEN 'REVIEW' WHEN 'REMOTE' THEN 'PASS' ELSE 'FAIL' END AS work,
  CASE WHEN purpose = 'UNKNOWN' THEN 'UNKNOWN' WHEN purpose = 'NONE' THEN 'PASS' WHEN purpose = 'FIELD_TRAVEL' THEN 'FAIL' WHEN purpose = 'CUSTOMER_ONSITE' THEN CASE WHEN often THEN 'FAIL' ELSE 'REVIEW' END
    WHEN purpose IN ('COMPANY_EVENT', 'CONFERENCE') AND NOT often THEN 'PASS' ELSE 'REVIEW' END AS travel, CASE WHEN role = 'UNRELATED' THEN 'FAIL' ELSE 'PASS' END AS role_fit
  FROM (SELECT *, coalesce(regexp_matches(frequency, 'weekly|monthly|frequent|recurring', 'i'), false) AS often FROM {FACT_ROWS.sql()}))"""
HARD_FILTER_CRITERIA = f"SELECT id, {', '.join(NAMED)} FROM {CRITERIA}"


def hard_filter_overall(spark, folder):
    return _criteria(FACT_ROWS.frame(spark, folder)).select("id", rules.overall(*map(F.col, NAMED)).alias("overall"))


_ALL = f"[{', '.join(NAMED)}]"
HARD_FILTER_OVERALL = f"SELECT id, CASE WHEN list_contains({_ALL}, 'FAIL') THEN 'FAIL' WHEN list_contains({_ALL}, 'REVIEW') OR list_contains({_ALL}, 'UNKNOWN') THEN 'REVIEW' ELSE 'PASS' END AS overall FROM {CRITERIA}"

TEXTS = "(VALUES (1, '  a b '), (2, ' '), (3, ''), (4, CAST(NULL AS VARCHAR(9))), (5, 'plain'), (6, 'IN_PROGRESS_NOW'), (7, '2026-02-28'), (8, '2026-02-30'), (9, '08/12/2026'), (10, '2024-02-29')) AS t(id, x)"


TEXT_ROWS = Rows(TEXTS, "part", {"id": "1000 + p_partkey", "x": "CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' WHEN 1 THEN upper(p_brand) ELSE CAST(date_add(DATE '2020-01-01', CAST(p_size AS INT)) AS VARCHAR(10)) END"})


def text_normalize(spark, folder):
    x = F.col("x")
    return TEXT_ROWS.frame(spark, folder).select("id", c.normal_text(x).alias("normal"), c.provenance_kind(x, c.normal_text(x)).alias("kind"), c.humanised(x).alias("shown"), c.strict_date(x).alias("date"))


TEXT_NORMALIZE = """
WITH t AS (SELECT id, x, nullif(regexp_replace(x, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+$', '', 'g'), '') AS normal FROM """ + TEXT_ROWS.sql() + """)
SELECT id, normal, CASE WHEN x IS NOT DISTINCT FROM normal THEN 'DIRECT' ELSE 'DETERMINISTIC' END AS kind, coalesce(nullif(list_aggregate(list_transform(string_split(replace(lower(x), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), ''), 'Unknown') AS shown,
  CASE WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(x AS DATE) END AS date FROM t"""

FIELDS = "(VALUES (1, ' Lead ', 'Acme', CAST(NULL AS VARCHAR(9))), (2, 'Manager', ' ', 'Lisbon')) AS t(id, title, company, location)"

FIELD_ROWS = Rows(FIELDS, "customer", {
    "id": "1000 + c_custkey", "title": "CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_name, ' ') WHEN 1 THEN c_name WHEN 2 THEN '   ' END", "company": "CASE WHEN c_nationkey % 3 = 0 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END",
    "location": "CASE WHEN c_nationkey > 12 THEN concat('nation ', c_nationkey) END",
})


def provenance_rows(spark, folder):
    """A row for every field that was given, with how its normal value came about."""
    rows = FIELD_ROWS.frame(spark, folder).select("id", F.expr("stack(3, 'title', title, 'company', company, 'location', location) AS (field, source)")).where("source is not null")
    return rows.select("id", "field", "source", c.normal_text(F.col("source")).alias("normal"), c.provenance_kind(F.col("source"), c.normal_text(F.col("source"))).alias("kind"))


PROVENANCE_ROWS = f"""SELECT id, field, source, nullif(trim(source), '') AS normal, CASE WHEN source IS NOT DISTINCT FROM nullif(trim(source), '') THEN 'DIRECT' ELSE 'DETERMINISTIC' END AS kind
FROM (SELECT id, unnest(['title', 'company', 'location']) AS field, unnest([title, company, location]) AS source FROM {FIELD_ROWS.sql()}) WHERE source IS NOT NULL"""

PRICE_COLUMNS = ["price_input", "price_cached", "price_output", "threshold", "input_factor", "output_factor", "currency"]
CONFIGS = f"(VALUES ('a', 1, 1.5, 0.1, 6.0, 50, 2.0, 1.5, NULL), ('b', 2, NULL, 0.1, 6.0, 50, 2.0, 1.5, 'USD'), ('c', 3, 2.5, 0.1, 6.0, 50, 2.0, 1.5, 'EUR')) AS t(model, version, {', '.join(PRICE_COLUMNS)})"
STORED = f"(VALUES ('a', 1, 1.5, 0.1, 6.0, 50, 2.0, 1.5, NULL), ('b', 2, 3.5, 0.1, 6.0, 50, 2.0, 1.5, 'USD'), ('d', 9, 1.0, 0.1, 6.0, 50, 2.0, 1.5, 'USD')) AS t(model, version, {', '.join(PRICE_COLUMNS)})"
_PRICED = {
    "model": "p_brand", "version": "p_partkey", "price_input": "p_retailprice", "price_cached": "CASE WHEN p_size > 10 THEN p_retailprice / 10 END", "price_output": "p_retailprice * 4", "threshold": "p_size",
    "input_factor": "2.0", "output_factor": "CASE WHEN p_size % 2 = 0 THEN 1.5 END", "currency": "CASE WHEN p_partkey % 2 = 0 THEN 'USD' END",
}
CONFIG_ROWS = Rows(CONFIGS, "part", _PRICED)
#: Every fifth part isn't stored; of the others some differ in one column, which one by the key.
STORED_ROWS = Rows(STORED, "part", {k: e if k in ("model", "version") else f"CASE WHEN p_partkey % 11 = {n} THEN NULL ELSE {e} END" for n, (k, e) in enumerate(_PRICED.items())}, "p_partkey % 5 <> 0")


def pricing_conflict(spark, folder):
    """Configurations against what is stored: equal in all nine columns (nulls too), different, or new."""
    new, old = CONFIG_ROWS.frame(spark, folder).alias("n"), STORED_ROWS.frame(spark, folder).alias("o")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")), k) for k in PRICE_COLUMNS)))
    state = F.when(F.col("o.model").isNull(), "INSERT").when(F.size(differ) == 0, "SAME").otherwise("CONFLICT")
    joined = new.join(old, (F.col("n.model") == F.col("o.model")) & (F.col("n.version") == F.col("o.version")), "left")
    return joined.select("n.model", "n.version", state.alias("state"), F.when(F.col("o.model").isNotNull(), F.array_join(differ, ",")).alias("differ"))


PRICING_CONFLICT = f"""SELECT model, version, CASE WHEN differ IS NULL THEN 'INSERT' WHEN differ = '' THEN 'SAME' ELSE 'CONFLICT' END AS state, differ FROM (
SELECT n.model, n.version, CASE WHEN o.model IS NOT NULL THEN concat_ws(',', {', '.join(f"CASE WHEN n.{k} IS DISTINCT FROM o.{k} THEN '{k}' END" for k in PRICE_COLUMNS)}) END AS differ
FROM {CONFIG_ROWS.sql('n')} LEFT JOIN {STORED_ROWS.sql('o')} ON n.model = o.model AND n.version = o.version)"""

LAYERS = "(VALUES ('op1', 'd1', 'a1', 'e1'), ('op2', 'd2', 'a2', NULL), ('op3', 'd3', NULL, NULL), ('opX', NULL, NULL, 'e9')) AS t(operation, fallback, approved, environment)"

LAYER_ROWS = Rows(LAYERS, "customer", {
    "operation": "concat('operation-', c_custkey)", "fallback": "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END", "approved": "CASE WHEN c_nationkey % 2 = 0 THEN concat('approved ', c_nationkey) END",
    "environment": "CASE WHEN c_custkey % 7 = 0 THEN c_name END",
})


def override_merge(spark, folder):
    known = F.col("fallback").isNotNull()
    return LAYER_ROWS.frame(spark, folder).select("operation", F.when(known, F.coalesce("environment", "approved", "fallback")).alias("model"), F.when(~known, "unknown_operation").alias("violation"))


OVERRIDE_MERGE = f"SELECT operation, CASE WHEN fallback IS NOT NULL THEN coalesce(environment, approved, fallback) END AS model, CASE WHEN fallback IS NULL THEN 'unknown_operation' END AS violation FROM {LAYER_ROWS.sql()}"

REQUESTS = "(VALUES (1, true, 'NORMALIZED', true, 'cs', 'cs', true), (2, false, NULL, NULL, 'cs', NULL, NULL), (3, true, 'DISCOVERED', true, 'cs', 'cs', true), (4, true, 'NORMALIZED', false, 'cs', 'cs', true), (5, true, 'NORMALIZED', true, 'zz', 'cs', true), (6, true, 'NORMALIZED', true, 'cs', 'ops', true), (7, true, 'NORMALIZED', true, 'cs', 'cs', false)) AS t(id, found, status, has_text, domain, own_domain, profile_ok)"
GATE = [("not_found", "NOT found"), ("not_normalized", "status <> 'NORMALIZED'"), ("no_content", "NOT has_text"), ("unsupported_domain", "domain NOT IN ('cs', 'ops')"), ("domain_mismatch", "domain <> own_domain"), ("invalid_profile", "NOT profile_ok")]


REQUEST_ROWS = Rows(REQUESTS, "orders", {
    "id": "1000 + o_orderkey", "found": "o_orderkey % 13 <> 0", "status": pick("o_orderkey", "NORMALIZED", "NORMALIZED", "DISCOVERED"), "has_text": "o_custkey % 5 <> 0", "domain": pick("o_custkey", "cs", "cs", "ops", "zz"),
    "own_domain": pick("o_orderkey", "cs", "ops"), "profile_ok": "o_custkey % 7 <> 0",
})


def request_gate(spark, folder):
    return REQUEST_ROWS.frame(spark, folder).select("id", rules.first_error([(n, F.expr(e)) for n, e in GATE]).alias("error_code"))


REQUEST_GATE = f"""SELECT id, CASE WHEN NOT found THEN 'not_found' WHEN status <> 'NORMALIZED' THEN 'not_normalized' WHEN NOT has_text THEN 'no_content' WHEN NOT (domain = 'cs' OR domain = 'ops') THEN 'unsupported_domain'
  WHEN domain <> own_domain THEN 'domain_mismatch' WHEN NOT profile_ok THEN 'invalid_profile' END AS error_code FROM {REQUEST_ROWS.sql()}"""


LINE_ASSESSMENTS = {
    "kind": pick("l_partkey", *matching.CLASSES), "specificity": pick("l_suppkey", *matching.SPECIFICITIES), "basis": pick("l_orderkey", *matching.BASES), "requirement": pick("l_partkey + l_suppkey", *matching.CATEGORIES),
    "says_direct": "l_linenumber % 2 = 0",
}


def compatibility_matrix(spark, folder):
    """All combinations as a rule table (2,940 rows at most: ten of an axis or fewer), and how many assessments (lines) fall under each."""
    axes = [("kind", matching.CLASSES), ("specificity", matching.SPECIFICITIES), ("basis", matching.BASES), ("requirement", matching.CATEGORIES), ("says_direct", [False, True])]
    rules_ = spark.range(1).drop("id")
    for name, values in axes:
        rules_ = rules_.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    rules_ = rules_.withColumn("allowed", matching.allowed_evidence(*(F.col(n) for n, _ in axes)))
    found = table(spark, folder, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in LINE_ASSESSMENTS.items())).groupBy(*LINE_ASSESSMENTS).agg(F.count("*").alias("assessments"))
    return rules_.join(found, list(LINE_ASSESSMENTS), "left").withColumn("assessments", F.coalesce("assessments", F.lit(0)))


_MATRIX = """SELECT *, CASE WHEN kind = 'STRONG_MATCH' AND specificity IN ('TRANSFERABLE', 'UNSUPPORTED', 'UNKNOWN') THEN ''
  WHEN kind = 'TRANSFERABLE_MATCH' AND NOT (specificity = 'TRANSFERABLE' AND basis = 'BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE') THEN ''
  WHEN requirement = 'EXPERIENCE' AND basis = 'REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE' THEN ''
  WHEN specificity IN ('DIRECT_SAAS_CUSTOMER_SUCCESS', 'DIRECT_CUSTOMER_SUCCESS') OR requirement = 'INDUSTRY' OR (requirement = 'EXPERIENCE' AND says_direct)
    THEN CASE WHEN basis = 'DIRECT_OR_RELATED_WORK_EXPERIENCE' THEN 'DIRECT_EXPERIENCE' ELSE '' END
  WHEN basis = 'DIRECT_OR_RELATED_WORK_EXPERIENCE' THEN 'DIRECT_EXPERIENCE,RELATED_EXPERIENCE'
  WHEN basis = 'BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE' THEN 'DIRECT_EXPERIENCE,RELATED_EXPERIENCE,TRANSFERABLE_EXPERIENCE,TRANSFERABLE_SKILL' ELSE 'SKILL,TRANSFERABLE_SKILL' END AS allowed
FROM (VALUES ('STRONG_MATCH'), ('TRANSFERABLE_MATCH'), ('PARTIAL_MATCH')) AS a(kind)
CROSS JOIN (VALUES ('DIRECT_SAAS_CUSTOMER_SUCCESS'), ('DIRECT_CUSTOMER_SUCCESS'), ('RELATED_CUSTOMER_RELATIONSHIP'), ('BROADER_CUSTOMER_FACING'), ('TRANSFERABLE'), ('UNSUPPORTED'), ('UNKNOWN')) AS b(specificity)
CROSS JOIN (VALUES ('DIRECT_OR_RELATED_WORK_EXPERIENCE'), ('BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE'), ('REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE')) AS c(basis)
CROSS JOIN (VALUES ('EXPERIENCE'), ('CAPABILITY'), ('TOOL'), ('INDUSTRY'), ('EDUCATION'), ('CERTIFICATION'), ('TECHNICAL_KNOWLEDGE'), ('LANGUAGE'), ('LOCATION'), ('TRAVEL')) AS d(requirement)
CROSS JOIN (VALUES (true), (false)) AS e(says_direct)"""
COMPATIBILITY_MATRIX = f"""WITH l AS (SELECT {', '.join(f'{e} AS {n}' for n, e in LINE_ASSESSMENTS.items())} FROM lineitem), c AS (SELECT kind, specificity, basis, requirement, says_direct, count(*) AS n FROM l GROUP BY ALL)
SELECT m.*, coalesce(n, 0) AS assessments FROM ({_MATRIX}) AS m LEFT JOIN c USING (kind, specificity, basis, requirement, says_direct)"""

NEEDS = "(VALUES (1, 0, 'a', false), (1, 1, 'b', false), (1, 2, 'c', true), (2, 0, 'd', false), (2, 1, 'e', true)) AS t(opportunity_id, idx, text, ambiguous)"
GIVEN = "(VALUES (1, 0, 'STRONG_MATCH'), (1, 1, 'PARTIAL_MATCH'), (1, 1, 'GENUINE_GAP'), (2, 1, 'STRONG_MATCH'), (2, 7, 'GENUINE_GAP')) AS t(opportunity_id, idx, classification)"


NEED_ROWS = Rows(NEEDS, "lineitem", {"opportunity_id": "1000 + l_orderkey", "idx": "l_linenumber", "text": "'requirement ' || l_partkey", "ambiguous": "l_suppkey % 9 = 0"})
GIVEN_ROWS = Rows(GIVEN, "lineitem", {
    "opportunity_id": "1000 + l_orderkey", "idx": "CASE WHEN l_partkey % 10 = 0 THEN l_linenumber + 1 ELSE l_linenumber END", "classification": pick("l_partkey", "STRONG_MATCH", "PARTIAL_MATCH", "TRANSFERABLE_MATCH", "GENUINE_GAP"),
}, where="l_partkey % 5 <> 1")


def requirement_match(spark, folder):
    return matching.matched(_needs(spark, folder), GIVEN_ROWS.frame(spark, folder))


def _needs(spark, folder):
    """An index comes once; where the table repeats one, the first text holds."""
    return NEED_ROWS.frame(spark, folder).groupBy("opportunity_id", "idx").agg(F.min("text").alias("text"), F.bool_or("ambiguous").alias("ambiguous"))


_NEEDS = f"(SELECT opportunity_id, idx, min(text) AS text, bool_or(ambiguous) AS ambiguous FROM {NEED_ROWS.sql('x')} GROUP BY ALL)"


def requirement_eligible(spark, folder):
    return matching.eligible(_needs(spark, folder))


REQUIREMENT_ELIGIBLE = f"SELECT opportunity_id, idx AS requirement_index, text FROM {_NEEDS} WHERE NOT ambiguous"


_MATCHED = f"""(SELECT coalesce(n.opportunity_id, g.opportunity_id) AS opportunity_id, coalesce(n.idx, g.idx) AS idx, CASE WHEN ambiguous THEN 'UNKNOWN' ELSE given END AS classification,
  CASE WHEN text IS NULL THEN 'unknown_index' WHEN times > 1 THEN 'repeated_index' WHEN ambiguous AND times IS NOT NULL THEN 'ambiguous_index' WHEN NOT ambiguous AND times IS NULL THEN 'missing_index' END AS violation
  FROM {_NEEDS} n FULL OUTER JOIN (SELECT opportunity_id, idx, count(*) AS times, min(classification) AS given FROM {GIVEN_ROWS.sql()} GROUP BY ALL) g ON n.opportunity_id = g.opportunity_id AND n.idx = g.idx)"""
REQUIREMENT_MATCH = f"SELECT * FROM {_MATCHED}"


def genuine_gaps(spark, folder):
    gaps = GIVEN_ROWS.frame(spark, folder).where("classification = 'GENUINE_GAP'").groupBy("opportunity_id").agg(F.array_join(F.array_sort(F.collect_list("idx")), ",").alias("gaps"))
    return NEED_ROWS.frame(spark, folder).select("opportunity_id").distinct().join(gaps, "opportunity_id", "left")


GENUINE_GAPS = f"""SELECT n.opportunity_id, string_agg(CAST(g.idx AS VARCHAR), ',' ORDER BY g.idx) AS gaps FROM (SELECT DISTINCT opportunity_id FROM {NEED_ROWS.sql()}) n
LEFT JOIN (SELECT * FROM {GIVEN_ROWS.sql()} WHERE classification = 'GENUINE_GAP') g ON g.opportunity_id = n.opportunity_id GROUP BY 1"""

ASSESSED = """(VALUES (1, 'STRONG_MATCH', 'DIRECT_CUSTOMER_SUCCESS', 'NON_DECISIVE', 'REQUIRED', false, 'a', 'b', 'jd-1', 'profile-1', '', 'DIRECT_OR_RELATED_WORK_EXPERIENCE', 'EXPERIENCE', 'direct sales', 'DIRECT_EXPERIENCE', 'jd-1'),
  (2, 'GENUINE_GAP', 'UNSUPPORTED', 'DECISIVE_DISQUALIFIER', 'PREFERRED', true, NULL, NULL, 'jd-1', 'profile-1', '', 'NO_SUPPORTING_EXPERIENCE', 'TOOL', 'x', 'SKILL', 'jd-1'), (3, 'PARTIAL_MATCH', 'UNSUPPORTED', 'MATERIAL_UNCERTAINTY', 'REQUIRED', false, 'a', NULL, 'jd-2', 'profile-1', 'jd-9', 'REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE', 'EXPERIENCE', 'x', 'CAREER_GOAL', 'jd-1'),
  (4, 'UNKNOWN', 'TRANSFERABLE', 'NON_DECISIVE', 'IDEAL', true, NULL, NULL, 'jd-1', '', '', 'UNKNOWN', 'EXPERIENCE', 'x', '', 'jd-1'), (5, 'TRANSFERABLE_MATCH', 'BROADER_CUSTOMER_FACING', 'NON_DECISIVE', 'REQUIRED', false, 'a', 'b', 'jd-1', '', '', 'BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE', 'INDUSTRY', 'x', 'SKILL', 'jd-1'),
  (6, 'STRONG_MATCH', 'UNKNOWN', 'NON_DECISIVE', 'REQUIRED', false, 'a', 'b', 'jd-1', 'profile-1', '', 'DIRECT_OR_RELATED_WORK_EXPERIENCE', 'CAPABILITY', 'x', 'SKILL', 'jd-1'), (7, 'GENUINE_GAP', 'UNSUPPORTED', 'DECISIVE_DISQUALIFIER', 'REQUIRED', false, NULL, NULL, 'jd-1', 'profile-1', 'jd-1,profile-1', 'NO_SUPPORTING_EXPERIENCE', 'TOOL', 'x', '', 'jd-1')
) AS t(id, classification, specificity, impact, strength, ambiguous, supported, unsupported, jd, profile, impact_list, basis, category, requirement, type_list, source)"""
ASSESSED_ROWS = Rows(ASSESSED, "lineitem", {
    "id": "1000 + l_orderkey * 10 + l_linenumber", "classification": pick("l_partkey", "STRONG_MATCH", "TRANSFERABLE_MATCH", "PARTIAL_MATCH", "GENUINE_GAP", "UNKNOWN"), "specificity": pick("l_suppkey", *matching.SPECIFICITIES),
    "impact": pick("l_partkey + l_suppkey", "NON_DECISIVE", "NON_DECISIVE", "MATERIAL_UNCERTAINTY", "DECISIVE_DISQUALIFIER"), "strength": pick("l_orderkey", "REQUIRED", "PREFERRED", "IDEAL", "NICE_TO_HAVE", "AMBIGUOUS"), "ambiguous": "l_partkey % 6 = 0",
    "supported": "CASE WHEN l_linenumber > 1 THEN 's' END", "unsupported": "CASE WHEN l_linenumber > 2 THEN 'u' END", "jd": pick("l_orderkey", "jd-1", "jd-1,jd-2"), "profile": pick("l_suppkey", "profile-1", "", "profile-2"),
    "impact_list": pick("l_partkey", "", "jd-1", "jd-1,profile-1", "jd-9"), "basis": pick("l_orderkey", *matching.BASES, "NO_SUPPORTING_EXPERIENCE", "UNKNOWN"), "category": pick("l_partkey", *matching.CATEGORIES),
    "requirement": pick("l_suppkey", "direct sales", "startup life", "Direct work at a start-up", "x"), "type_list": pick("l_partkey", "DIRECT_EXPERIENCE", "RELATED_EXPERIENCE,SKILL", "TRANSFERABLE_SKILL", "", "CAREER_GOAL"), "source": pick("l_linenumber", "jd-1", "jd-2"),
})


def _assessed(spark, folder):
    words = lambda x: F.filter(F.split(x, ","), lambda s: s != "")
    named = {"jd_refs": "jd", "profile_refs": "profile", "impact_refs": "impact_list", "types": "type_list", "source_refs": "source"}
    return ASSESSED_ROWS.frame(spark, folder).withColumns({n: words(F.col(c)) for n, c in named.items()}).withColumn("requested", F.lit(None).cast("string"))


def match_violations(spark, folder):
    """All that is wrong with each assessment, and with the evidence for it."""
    found = [F.array_join(rules.reasons(checks), ",") for checks in (matching.assessment_rules(), matching.evidence_rules())]
    return _assessed(spark, folder).select("id", found[0].alias("violations"), found[1].alias("evidence_violations"))


MATCH_VIOLATIONS = f"""
WITH t AS (SELECT *, list_filter(string_split(jd, ','), lambda s: s <> '') AS j, list_filter(string_split(profile, ','), lambda s: s <> '') AS p, list_filter(string_split(impact_list, ','), lambda s: s <> '') AS i,
    list_filter(string_split(type_list, ','), lambda s: s <> '') AS y, list_filter(string_split(source, ','), lambda s: s <> '') AS o,
    classification IN ('STRONG_MATCH', 'PARTIAL_MATCH', 'TRANSFERABLE_MATCH') AS positive, basis = 'DIRECT_OR_RELATED_WORK_EXPERIENCE' AND list_contains(string_split(type_list, ','), 'DIRECT_EXPERIENCE') AS shown FROM {ASSESSED_ROWS.sql('a')})
SELECT id, concat_ws(',', CASE WHEN classification <> 'UNKNOWN' AND len(p) = 0 THEN 'assessed_needs_profile_evidence' END, CASE WHEN classification = 'TRANSFERABLE_MATCH' AND specificity <> 'TRANSFERABLE' THEN 'transferable_stays_transferable' END,
  CASE WHEN classification = 'STRONG_MATCH' AND specificity IN ('TRANSFERABLE', 'UNSUPPORTED', 'UNKNOWN') THEN 'strong_is_not_transferable' END, CASE WHEN classification = 'UNKNOWN' AND specificity <> 'UNKNOWN' THEN 'unknown_has_no_specificity' END,
  CASE WHEN classification = 'GENUINE_GAP' AND specificity <> 'UNSUPPORTED' THEN 'gap_is_unsupported' END, CASE WHEN classification = 'GENUINE_GAP' AND ambiguous THEN 'ambiguous_is_no_gap' END,
  CASE WHEN classification <> 'GENUINE_GAP' AND impact <> 'NON_DECISIVE' THEN 'only_gaps_have_impact' END, CASE WHEN impact = 'DECISIVE_DISQUALIFIER' AND strength <> 'REQUIRED' THEN 'decisive_must_be_required' END,
  CASE WHEN impact = 'DECISIVE_DISQUALIFIER' AND len(i) = 0 THEN 'decisive_needs_evidence' END, CASE WHEN classification = 'PARTIAL_MATCH' AND (supported IS NULL OR unsupported IS NULL) THEN 'partial_needs_both_portions' END) AS violations,
  concat_ws(',', CASE WHEN basis = 'DIRECT_OR_RELATED_WORK_EXPERIENCE' AND NOT list_has_any(y, ['DIRECT_EXPERIENCE', 'RELATED_EXPERIENCE']) THEN 'no_direct_or_related_evidence' END,
  CASE WHEN basis = 'BROADER_OR_TRANSFERABLE_WORK_EXPERIENCE' AND NOT list_has_any(y, ['DIRECT_EXPERIENCE', 'RELATED_EXPERIENCE', 'TRANSFERABLE_EXPERIENCE', 'TRANSFERABLE_SKILL']) THEN 'no_experience_evidence' END,
  CASE WHEN basis = 'REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE' AND NOT list_has_any(y, ['SKILL', 'TRANSFERABLE_SKILL']) THEN 'no_skill_evidence' END, CASE WHEN category = 'INDUSTRY' AND positive AND NOT shown THEN 'industry_without_direct' END,
  CASE WHEN category = 'EXPERIENCE' AND basis = 'REQUIREMENT_RELEVANT_SKILL_OR_KNOWLEDGE' AND classification <> 'UNKNOWN' THEN 'skill_as_employment' END,
  CASE WHEN category = 'EXPERIENCE' AND regexp_matches(requirement, '\\bdirect\\b', 'i') AND positive AND NOT shown THEN 'direct_not_shown' END,
  CASE WHEN specificity IN ('DIRECT_SAAS_CUSTOMER_SUCCESS', 'DIRECT_CUSTOMER_SUCCESS') AND NOT shown THEN 'claims_direct_without_evidence' END, CASE WHEN NOT list_has_any(j, o) THEN 'not_connected_to_source' END,
  CASE WHEN len(list_filter(i, lambda x: NOT list_contains(j, x) AND NOT list_contains(p, x))) > 0 THEN 'impact_outside_assessment' END,
  CASE WHEN impact = 'DECISIVE_DISQUALIFIER' AND NOT (list_has_any(i, j) AND list_has_any(i, p)) THEN 'impact_needs_both_sides' END) AS evidence_violations FROM t"""


def specialisation_cues(spark, folder):
    """What a requirement asks for in particular, and whether a piece of evidence can show it."""
    rows = _assessed(spark, folder).withColumn("kind", F.get("types", F.lit(0)))
    source = F.when(F.col("id") % 4 == 0, "MANUAL").otherwise("USER_PROFILE")
    marked = F.when(F.col("id") % 5 == 0, F.col("id") % 2 == 0)
    return rows.select(
        "id", matching.direct_work_required(F.col("category"), F.col("requirement"), F.col("requested")).alias("direct"), matching.startup_required(F.col("category"), F.col("requirement"), F.col("requested")).alias("startup"),
        F.coalesce(matching.startup_supported(source, F.col("kind"), F.col("requirement"), F.lit(None).cast("string"), marked), F.lit(False)).alias("supported"),
    )


SPECIALISATION_CUES = f"""SELECT id, category = 'INDUSTRY' OR (category = 'EXPERIENCE' AND regexp_matches(requirement, '\\bdirect\\b', 'i')) AS direct, category = 'EXPERIENCE' AND regexp_matches(requirement, '\\b(startups?|start-ups?)\\b', 'i') AS startup,
  id % 4 <> 0 AND CASE WHEN id % 5 = 0 THEN id % 2 = 0 ELSE string_split(type_list, ',')[1] IN ('DIRECT_EXPERIENCE', 'RELATED_EXPERIENCE', 'TRANSFERABLE_EXPERIENCE', 'TRANSFERABLE_SKILL') AND regexp_matches(requirement, '\\b(startups?|start-ups?)\\b', 'i') END AS supported
FROM {ASSESSED_ROWS.sql()}"""

WANTED = "(VALUES (1, 'B2B', 'SAAS', 'BUSINESS', 'SMB'), (2, 'B2C', 'HARDWARE', 'CONSUMER', 'ENTERPRISE'), (3, 'PUBLIC', NULL, NULL, NULL), (4, NULL, 'SAAS', 'UNKNOWN', 'UNKNOWN'), (5, 'UNKNOWN', 'UNKNOWN', 'BUSINESS', 'OTHER')) AS t(id, business, product, customer, segment)"
WANTED_ROWS = Rows(WANTED, "customer", {"id": "1000 + c_custkey", "business": pick("c_custkey", "B2B", "B2C", "PUBLIC", "UNKNOWN"), "product": pick("c_nationkey", "SAAS", "HARDWARE", None), "customer": "c_mktsegment", "segment": pick("c_custkey", "SMB", "ENTERPRISE", "UNKNOWN")})


def preference_membership(spark, folder):
    wanted = {"business": ["B2B"], "also_business": ["B2C"], "product": ["SAAS"], "customer": ["BUSINESS", "BUILDING"], "segment": ["SMB", "MID_MARKET"]}
    told = rules.preference_findings(*map(F.col, ("business", "product", "customer", "segment")), wanted)
    return WANTED_ROWS.frame(spark, folder).select("id", F.array_join(told, " ").alias("findings"))


PREFERENCE_MEMBERSHIP = f"""SELECT id, CASE WHEN business IS NULL OR business = 'UNKNOWN' THEN 'Configured business-model alignment remains Unknown.' WHEN business = 'B2B' THEN 'B2B is a configured preferred business model.'
    WHEN business = 'B2C' THEN 'B2C is a configured also-aligned business model.' ELSE business || ' is not listed as a preferred or also-aligned business model.' END || ' ' ||
  CASE WHEN product IS NULL OR product = 'UNKNOWN' THEN 'Configured product-type alignment remains Unknown.' WHEN product = 'SAAS' THEN 'SAAS is a configured preferred product type.' ELSE product || ' requires contextual alignment evaluation.' END || ' ' ||
  CASE WHEN customer IS NULL OR customer = 'UNKNOWN' THEN 'Configured customer-type alignment remains Unknown.' WHEN customer IN ('BUSINESS', 'BUILDING') THEN customer || ' is represented in the configured customer-type preferences.'
    ELSE customer || ' is outside the configured customer-type preferences.' END || ' ' ||
  CASE WHEN segment IS NULL OR segment = 'UNKNOWN' THEN 'Configured customer-segment alignment remains Unknown.' WHEN segment IN ('SMB', 'MID_MARKET') THEN segment || ' is represented in the configured customer-segment preferences.'
    ELSE segment || ' is outside the configured customer-segment preferences.' END AS findings FROM {WANTED_ROWS.sql()}"""

RELATED = "(VALUES (1, 'support', 'SHARES', 'jd-1'), (1, 'sales', 'COLLABORATES', 'jd-2'), (1, 'product', 'OWNS', 'jd-3'), (2, 'sales', 'UNCLEAR_BOUNDARIES', 'jd-1'), (2, 'product', 'OWNS', 'jd-2'), (3, 'projectManagement', 'HANDS_OFF_TO', 'jd-1'), (3, 'education', 'RECEIVES_FROM', 'jd-1')) AS t(opportunity_id, function, relationship, ref)"
RELATED_ROWS = Rows(RELATED, "lineitem", {
    "opportunity_id": "1000 + l_orderkey", "function": pick("l_linenumber", *matching.FUNCTIONS), "relationship": pick("l_partkey", "OWNS", "SHARES", "COLLABORATES", "HANDS_OFF_TO", "RECEIVES_FROM", "UNCLEAR_BOUNDARIES"), "ref": "'jd-' || (l_suppkey % 3)",
})


def _related(spark, folder):
    """A function has one relationship; where the table repeats one, the least holds."""
    rows = RELATED_ROWS.frame(spark, folder).groupBy("opportunity_id", "function").agg(F.min("relationship").alias("relationship"), F.array_sort(F.collect_set("ref")).alias("refs"))
    return matching.relationships(rows)


def relationship_catalog(spark, folder):
    return _related(spark, folder).select("opportunity_id", "state", "conclusion", F.array_join("refs", ",").alias("refs"))


_CATALOG = f"""(WITH r AS (SELECT opportunity_id, function, min(relationship) AS relationship, list_sort(list(DISTINCT ref)) AS refs FROM {RELATED_ROWS.sql()} GROUP BY ALL),
k AS (SELECT opportunity_id, p.place, CASE relationship WHEN 'SHARES' THEN 'shares work with' WHEN 'COLLABORATES' THEN 'collaborates with' WHEN 'HANDS_OFF_TO' THEN 'hands off to' WHEN 'RECEIVES_FROM' THEN 'receives work from' END || ' ' || label AS told, refs
  FROM r JOIN (VALUES (1, 'customerSuccess', 'Customer Success'), (2, 'sales', 'Sales'), (3, 'support', 'Support'), (4, 'product', 'Product'), (5, 'implementation', 'Implementation'), (6, 'education', 'Education'), (7, 'community', 'Community'),
    (8, 'marketing', 'Marketing'), (9, 'projectManagement', 'Project Management')) AS p(place, name, label) ON p.name = r.function WHERE relationship NOT IN ('OWNS', 'UNCLEAR_BOUNDARIES')),
f AS (SELECT opportunity_id, ref, min(place * 100 + n) AS pos FROM (SELECT opportunity_id, place, unnest(refs) AS ref, generate_subscripts(refs, 1) AS n FROM k) GROUP BY ALL),
g AS (SELECT opportunity_id, string_agg(ref, ',' ORDER BY pos) AS refs FROM f GROUP BY 1),
c AS (SELECT opportunity_id, 'Cross-functional relationships: ' || string_agg(told, '; ' ORDER BY place) || '.' AS conclusion FROM k GROUP BY 1)
SELECT o.opportunity_id, CASE WHEN conclusion IS NULL THEN 'NOT_ESTABLISHED' ELSE 'SUPPORTED_PRESENT' END AS state, conclusion, coalesce(refs, '') AS refs FROM (SELECT DISTINCT opportunity_id FROM r) o
LEFT JOIN c ON c.opportunity_id = o.opportunity_id LEFT JOIN g ON g.opportunity_id = o.opportunity_id)"""
RELATIONSHIP_CATALOG = f"SELECT * FROM {_CATALOG}"


def relationship_restore(spark, folder):
    """Stored results whose relationships are told anew from the catalog."""
    catalog = _related(spark, folder)
    codes = F.when(F.col("opportunity_id") % 2 == 0, F.array(F.lit(matching.NOT_ESTABLISHED), F.lit("other"))).otherwise(F.array(F.lit("other")))
    stored = catalog.select("opportunity_id", F.lit("old").alias("conclusion"), codes.alias("unknowns"))
    out = matching.restored_relationships(stored, catalog)
    return out.select("opportunity_id", "conclusion", "unknown", F.array_join("refs", ",").alias("refs"), F.array_join("unknowns", ",").alias("unknowns"))


RELATIONSHIP_RESTORE = f"""SELECT opportunity_id, conclusion, state = 'NOT_ESTABLISHED' AS unknown, refs,
  CASE WHEN state = 'NOT_ESTABLISHED' THEN 'other,organizational-maturity-cross-functional-relationships-not-established' ELSE 'other' END AS unknowns FROM {_CATALOG}"""

DIMENSIONS = "(VALUES (1, 'onboarding', 'SUPPORTED_PRESENT', 'There is a playbook.'), (1, 'renewal', 'NOT_ESTABLISHED', NULL), (1, 'metrics', 'SUPPORTED_ABSENT', 'Metrics are not specified anywhere.'), (2, 'metrics', 'SUPPORTED_PRESENT', 'There is no information on it.'), (3, 'metrics', 'SUPPORTED_PRESENT', 'Owners could not establish it')) AS t(opportunity_id, dimension, state, conclusion)"
DIMENSION_ROWS = Rows(DIMENSIONS, "documents", {"opportunity_id": "1000 + doc_id", "dimension": "source", "state": pick("doc_id", "SUPPORTED_PRESENT", "SUPPORTED_ABSENT", "NOT_ESTABLISHED"), "conclusion": "text"})


def maturity_dimensions(spark, folder):
    out = matching.maturity(DIMENSION_ROWS.frame(spark, folder))
    return out.withColumn("conclusion", F.md5("conclusion"))


MATURITY_DIMENSIONS = f"""SELECT opportunity_id, dimension, CASE WHEN state <> 'NOT_ESTABLISHED' THEN md5(conclusion) END AS conclusion, state = 'NOT_ESTABLISHED' AS unknown,
  CASE WHEN state <> 'NOT_ESTABLISHED' AND regexp_matches(conclusion, '{quoted(matching.MISSING_INFORMATION)}', 'i') THEN 'evidence_state_invalid' END AS violation FROM {DIMENSION_ROWS.sql()}"""

PROFILES = """(VALUES (1, '{"careerGoals":[{"statement":"Grow"},{"statement":"Lead"}],"skills":[{"statement":"SQL"}]}'), (2, '{"skills":[],"experience":[{"statement":"Ran onboarding","relationship":"DIRECT"}]}'), (3, '{}'),
  (4, '{"transferableSkills":[{"statement":"Teaching"}],"workPreferences":[{"statement":"Remote"}],"experience":[{"statement":"a","relationship":"RELATED"},{"statement":"b","relationship":"TRANSFERABLE"}]}')) AS t(profile_id, data)"""
PROFILE_ROWS = Rows(PROFILES, "customer", {
    "profile_id": "1000 + c_custkey", "data": """'{"careerGoals":[{"statement":"' || c_mktsegment || '"}],"experience":[{"statement":"' || c_name || '","relationship":"' || """ + pick("c_nationkey", "DIRECT", "RELATED", "TRANSFERABLE") + """ || '"}],"skills":[{"statement":"s1"},{"statement":"n' || c_nationkey || '"}]}'""",
})
# Sections in their order, what their references are called, and the evidence they give.
SECTIONS = [("careerGoals", "career-goals", "CAREER_GOAL"), ("experience", "experience", None), ("skills", "skills", "SKILL"), ("transferableSkills", "transferable-skills", "TRANSFERABLE_SKILL"), ("workPreferences", "work-preferences", "WORK_PREFERENCE")]


def profile_evidence(spark, folder):
    """A row a statement of the five sections, numbered within its section from 0."""
    shape = "struct<" + ",".join(f"{n}:array<struct<statement:string,relationship:string>>" for n, _, _ in SECTIONS) + ">"
    rows = PROFILE_ROWS.frame(spark, folder).select("profile_id", F.from_json("data", shape).alias("p"))

    def told(name, label, kind):
        of = lambda x: F.lit(kind) if kind else F.concat(x["relationship"], F.lit("_EXPERIENCE"))
        return F.transform(
            F.coalesce(F.col(f"p.{name}"), F.array()), lambda x, i: F.struct(F.concat(F.lit(f"{label}-"), i).alias("section_ref"), x["statement"].alias("statement"), of(x).alias("evidence_type"))
        )

    out = rows.select("profile_id", F.explode(F.concat(*(told(*x) for x in SECTIONS))).alias("e"))
    return out.select("profile_id", F.concat(F.lit("profile-"), "e.section_ref").alias("reference_id"), "e.statement", "e.evidence_type")


def _section(name, label, kind):
    of = f"'{kind}'" if kind else "(e->>'relationship') || '_EXPERIENCE'"
    return f"""SELECT profile_id, 'profile-{label}-' || (n - 1) AS reference_id, e->>'statement' AS statement, {of} AS evidence_type
FROM (SELECT profile_id, unnest(es) AS e, generate_subscripts(es, 1) AS n FROM (SELECT profile_id, CAST(json_extract(data, '$.{name}') AS JSON[]) AS es FROM {PROFILE_ROWS.sql()}))"""


PROFILE_EVIDENCE = " UNION ALL ".join(_section(*x) for x in SECTIONS)

HISTORIES = """(VALUES (1, 0, '[{"type":"REPOSTED","description":"r"},{"type":"CURRENT_POSTING","description":"c"}]'), (1, 1, 'not json'), (2, 0, '[{"type":"REPOSTED","description":"a"},{"type":"UNCHANGED_OVER_TIME","description":"b"}]'), (3, 0, '[]'), (4, 0, '[{"type":"CLOSED_ATS_VISIBLE_ELSEWHERE","description":"x"},{"type":"AGGREGATOR_VISIBILITY","description":"y"}]')) AS t(opportunity_id, source_no, payload)"""
# Facts that tell of risk, those that do so alone, and those of an active posting.
RISKS = ["REPOSTED", "UNCHANGED_OVER_TIME", "EVERGREEN_LANGUAGE", "FARMING_INDICATOR", "CLOSED_ATS_VISIBLE_ELSEWHERE", "RECURRING_IDENTICAL_REQUISITION"]
COMPOUND, ACTIVE = ["CLOSED_ATS_VISIBLE_ELSEWHERE", "RECURRING_IDENTICAL_REQUISITION"], ["ACTIVE_ATS", "CURRENT_POSTING"]
HISTORY_ROWS = Rows(HISTORIES, "lineitem", {"opportunity_id": "1000 + l_orderkey", "source_no": "l_linenumber", "payload": "'[{\"type\":\"' || " + pick("l_partkey", *RISKS, "AGGREGATOR_VISIBILITY", *ACTIVE) + " || '\",\"description\":\"d' || l_suppkey || '\"}]'"})


def _facts(spark, folder):
    parsed = F.from_json("payload", "array<struct<type string, description string>>")
    rows = HISTORY_ROWS.frame(spark, folder).select("opportunity_id", "source_no", F.posexplode(parsed).alias("pos", "fact"))
    rows = rows.where("fact.type is not null")  # a payload that can't be parsed has no facts
    return rows.select("opportunity_id", F.concat_ws("-", F.lit("posting-history"), "source_no", "pos").alias("reference_id"), "fact.type", "fact.description")


def posting_history(spark, folder):
    return _facts(spark, folder)


_DUCK_FACTS = f"""(SELECT opportunity_id, 'posting-history-' || source_no || '-' || (n - 1) AS reference_id, f->>'type' AS type, f->>'description' AS description FROM
  (SELECT opportunity_id, source_no, unnest(fs) AS f, generate_subscripts(fs, 1) AS n FROM (SELECT opportunity_id, source_no, CAST(payload AS JSON[]) AS fs FROM {HISTORY_ROWS.sql()} WHERE json_valid(payload))))"""
POSTING_HISTORY = f"SELECT * FROM {_DUCK_FACTS}"


def signal_gate(spark, folder):
    """Which classes the facts of an opportunity may support."""
    count = lambda names: F.count_if(F.col("type").isin(names))
    risky = (count(RISKS) >= 2) | (count(COMPOUND) >= 1)
    return _facts(spark, folder).groupBy("opportunity_id").agg(risky.alias("may_be_elevated"), (count(ACTIVE) >= 1).alias("may_be_low"))


SIGNAL_GATE = f"""SELECT opportunity_id, count(*) FILTER (type IN ('REPOSTED', 'UNCHANGED_OVER_TIME', 'EVERGREEN_LANGUAGE', 'FARMING_INDICATOR', 'CLOSED_ATS_VISIBLE_ELSEWHERE', 'RECURRING_IDENTICAL_REQUISITION')) >= 2
    OR count(*) FILTER (type IN ('CLOSED_ATS_VISIBLE_ELSEWHERE', 'RECURRING_IDENTICAL_REQUISITION')) >= 1 AS may_be_elevated, count(*) FILTER (type IN ('ACTIVE_ATS', 'CURRENT_POSTING')) >= 1 AS may_be_low
FROM {_DUCK_FACTS} GROUP BY 1"""

RESULTS = """(VALUES (1, 'PASS', 'CORE_CS', 'AT_LEVEL', 'LOW', 'HIGH', 'LOW'), (2, 'FAIL', 'CORE_CS', 'AT_LEVEL', 'LOW', 'HIGH', 'LOW'), (3, 'PASS', 'CORE_CS', 'ABOVE_LEVEL', 'LOW', 'HIGH', 'LOW'), (4, 'PASS', 'CORE_CS', 'AT_LEVEL', 'LOW', 'HIGH', 'LOW'),
  (5, 'PASS', 'CORE_CS', 'AT_LEVEL', 'LOW', 'HIGH', 'LOW'), (6, 'PASS', 'CORE_CS', 'AT_LEVEL', 'LOW', 'HIGH', 'LOW'), (7, 'PASS', 'CORE_CS', 'AT_LEVEL', 'VERY_HIGH', 'HIGH', 'LOW'), (8, 'PASS', 'CORE_CS', 'AT_LEVEL', 'HIGH', 'HIGH', 'LOW'),
  (9, 'REVIEW', 'CORE_CS', 'AT_LEVEL', 'LOW', 'LOW', 'POSSIBLE'), (10, 'PASS', 'UNRELATED', 'AT_LEVEL', 'LOW', 'HIGH', 'HIGH')) AS t(id, overall, role, level, burnout, fit, history)"""
RESULT_ROWS = Rows(RESULTS, "orders", {
    "id": "1000 + o_orderkey", "overall": pick("o_custkey", "PASS", "PASS", "REVIEW", "PASS", "FAIL"), "role": pick("o_orderkey", "CORE_CS", "CS_ADJACENT", "TECHNICAL_CS", "SUPPORT_HEAVY", "CORE_CS", "CORE_CS", "UNRELATED"), "level": pick("o_custkey + o_orderkey", "AT_LEVEL", "BELOW_LEVEL", "AT_LEVEL", "AT_LEVEL", "ABOVE_LEVEL"),
    "burnout": pick("o_custkey", "LOW", "MIXED_MODERATE", "LOW", "HIGH", "LOW", "LOW", "VERY_HIGH"), "fit": pick("o_orderkey", "HIGH", "GOOD", "LOW"), "history": pick("o_custkey", "LOW", "UNKNOWN", "LOW", "LOW", "POSSIBLE", "LOW", "ELEVATED", "HIGH", "LOW"),
})
GAPS = """(VALUES (4, 0, 'REQUIRED', 'GENUINE_GAP', 'DECISIVE_DISQUALIFIER', 'jd-1,profile-1'), (5, 0, 'REQUIRED', 'GENUINE_GAP', 'MATERIAL_UNCERTAINTY', 'jd-1'), (6, 0, 'REQUIRED', 'GENUINE_GAP', 'DECISIVE_DISQUALIFIER', 'jd-2'),
  (1, 0, 'PREFERRED', 'GENUINE_GAP', 'MATERIAL_UNCERTAINTY', 'jd-1'), (1, 1, 'REQUIRED', 'STRONG_MATCH', 'NON_DECISIVE', 'jd-1')) AS t(id, requirement_index, strength, classification, impact, refs)"""
GAP_ROWS = Rows(GAPS, "lineitem", {
    "id": "1000 + l_orderkey", "requirement_index": "l_linenumber", "strength": pick("l_partkey", "REQUIRED", "PREFERRED", "REQUIRED", "IDEAL"), "classification": pick("l_suppkey", "GENUINE_GAP", "STRONG_MATCH", "PARTIAL_MATCH", "UNKNOWN"),
    "impact": pick("l_partkey", "DECISIVE_DISQUALIFIER", "NON_DECISIVE", "MATERIAL_UNCERTAINTY", "NON_DECISIVE", "NON_DECISIVE"), "refs": "'jd-' || l_linenumber || ',profile-' || (l_suppkey % 4)",
})
CONTRADICTIONS = "(VALUES (6, 'jd-9', 'jd-2'), (6, 'jd-9', 'jd-8')) AS t(id, refs_a, refs_b)"
CONTRADICTION_ROWS = Rows(CONTRADICTIONS, "lineitem", {"id": "1000 + l_orderkey", "refs_a": "'jd-' || l_linenumber", "refs_b": "'jd-' || (l_linenumber + 1)"}, where="l_partkey % 7 = 0")
#: The sentences of a decision, each with the rule that gives it.
SKIP = [
    ("A deterministic hard filter failed.", "overall = 'FAIL'"), ("The reconstructed actual work is unrelated to Customer Success.", "role = 'UNRELATED'"), ("Effective Seniority is Above Level.", "level = 'ABOVE_LEVEL'"),
    ("A required, genuinely unsupported qualification is established by evidence as a decisive disqualifier.", "decisive"), ("The combined role design has Very High burnout risk.", "burnout = 'VERY_HIGH'"),
]
REVIEW = [
    ("A required Genuine Gap has materially unresolved applicability or decision importance.", "uncertain"), ("Effective-seniority evidence contains a material contradiction.", "contradicting"), ("The role has High burnout risk that requires review.", "burnout = 'HIGH'"),
    ("One or more hard-filter criteria require review or clarification.", "overall = 'REVIEW'"), ("The holistic fit assessment is Low and needs a deliberate decision.", "fit = 'LOW'"),
    ("Available posting-history evidence raises an unresolved hiring-activity concern.", "history IN ('POSSIBLE', 'ELEVATED', 'HIGH')"),
]


def _judged(spark, folder):
    """Results with what their required gaps amount to: a gap that a contradiction shares a reference with is uncertain, not decisive."""
    words = lambda x: F.split(x, ",")
    both = CONTRADICTION_ROWS.frame(spark, folder).withColumn("ref", F.explode(F.array_union(words(F.col("refs_a")), words(F.col("refs_b")))))
    gaps = GAP_ROWS.frame(spark, folder).where("strength = 'REQUIRED' and classification = 'GENUINE_GAP'")
    shared = gaps.withColumn("ref", F.explode(words(F.col("refs")))).join(both.select("id", "ref").distinct(), ["id", "ref"], "left_semi").select("id", "requirement_index").distinct().withColumn("contradicted", F.lit(True))
    told = gaps.join(shared, ["id", "requirement_index"], "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    folded = told.groupBy("id").agg(
        F.bool_or((F.col("impact") == "DECISIVE_DISQUALIFIER") & ~F.col("contradicted")).alias("decisive"), F.bool_or((F.col("impact") == "MATERIAL_UNCERTAINTY") | F.col("contradicted")).alias("uncertain")
    )
    some = both.select("id").distinct().withColumn("contradicting", F.lit(True))
    return RESULT_ROWS.frame(spark, folder).join(folded, "id", "left").join(some, "id", "left").fillna(False, ["decisive", "uncertain", "contradicting"])


def _decided(df):
    skip, review = (rules.reasons([(n, F.expr(e)) for n, e in options]) for options in (SKIP, REVIEW))
    return df.withColumns({"decision": rules.decision(skip, review), "skip_reasons": F.array_join(skip, " "), "review_reasons": F.array_join(review, " ")})


def decision_precedence(spark, folder):
    return _decided(_judged(spark, folder)).select("id", "decision", "skip_reasons", "review_reasons")


_JUDGED = f"""(WITH g AS (SELECT *, EXISTS (SELECT 1 FROM {CONTRADICTION_ROWS.sql('c')} WHERE c.id = q.id AND list_has_any(string_split(q.refs, ','), list_concat(string_split(c.refs_a, ','), string_split(c.refs_b, ',')))) AS contradicted
  FROM {GAP_ROWS.sql('q')} WHERE strength = 'REQUIRED' AND classification = 'GENUINE_GAP'),
f AS (SELECT id, bool_or(impact = 'DECISIVE_DISQUALIFIER' AND NOT contradicted) AS decisive, bool_or(impact = 'MATERIAL_UNCERTAINTY' OR contradicted) AS uncertain FROM g GROUP BY 1)
SELECT r.*, coalesce(decisive, false) AS decisive, coalesce(uncertain, false) AS uncertain, r.id IN (SELECT id FROM {CONTRADICTION_ROWS.sql('x')}) AS contradicting FROM {RESULT_ROWS.sql('r')} LEFT JOIN f ON f.id = r.id)"""


def _decide(relation, key="id"):
    return f"""SELECT {key}, CASE WHEN s <> '' THEN 'SKIP' WHEN v <> '' THEN 'REVIEW' ELSE 'APPLY' END AS decision, s AS skip_reasons, v AS review_reasons FROM (SELECT *,
  concat_ws(' ', CASE WHEN overall = 'FAIL' THEN 'A deterministic hard filter failed.' END, CASE WHEN role = 'UNRELATED' THEN 'The reconstructed actual work is unrelated to Customer Success.' END, CASE WHEN level = 'ABOVE_LEVEL' THEN 'Effective Seniority is Above Level.' END,
    CASE WHEN decisive THEN 'A required, genuinely unsupported qualification is established by evidence as a decisive disqualifier.' END, CASE WHEN burnout = 'VERY_HIGH' THEN 'The combined role design has Very High burnout risk.' END) AS s,
  concat_ws(' ', CASE WHEN uncertain THEN 'A required Genuine Gap has materially unresolved applicability or decision importance.' END, CASE WHEN contradicting THEN 'Effective-seniority evidence contains a material contradiction.' END,
    CASE WHEN burnout = 'HIGH' THEN 'The role has High burnout risk that requires review.' END, CASE WHEN overall = 'REVIEW' THEN 'One or more hard-filter criteria require review or clarification.' END,
    CASE WHEN fit = 'LOW' THEN 'The holistic fit assessment is Low and needs a deliberate decision.' END, CASE WHEN history IN ('POSSIBLE', 'ELEVATED', 'HIGH') THEN 'Available posting-history evidence raises an unresolved hiring-activity concern.' END) AS v FROM {relation})"""


DECISION_PRECEDENCE = _decide(_JUDGED)

FINDINGS = """(VALUES (1, 0, 'strengths', true, 'Strong team'), (1, 1, 'strengths', true, 'Strong team'), (1, 2, 'strengths', true, 'Good pay'), (1, 3, 'concerns', false, 'Hidden'), (2, 0, 'concerns', true, 'Slow'), (2, 1, 'unknowns', true, 'no-age'),
  (2, 2, 'contradictions', true, 'field:a:b'), (2, 3, 'contradictions', true, 'field:a:b')) AS t(id, pos, list, evaluated, finding)"""
FINDING_ROWS = Rows(FINDINGS, "lineitem", {
    "id": "1000 + l_orderkey", "pos": "l_linenumber * CAST(1000000000 AS BIGINT) + l_partkey", "list": pick("l_suppkey", "strengths", "concerns", "unknowns", "contradictions"), "evaluated": "l_partkey % 3 <> 0", "finding": "'finding ' || (l_suppkey % 7)",
})
LISTS = ["strengths", "concerns", "unknowns", "contradictions"]


def findings_rollup(spark, folder):
    """The four lists of an evaluation: distinct findings of evaluated stages in the order they first come."""
    rows = FINDING_ROWS.frame(spark, folder).where("evaluated")
    first = rows.groupBy("id", "list", "finding").agg(F.min("pos").alias("pos"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding"))), lambda x: x["finding"])
    return first.groupBy("id", "list").agg(F.array_join(items, "; ").alias("items")).groupBy("id").pivot("list", LISTS).agg(F.first("items"))


FINDINGS_ROLLUP = "SELECT id, " + ", ".join(f"string_agg(finding, '; ' ORDER BY pos, finding) FILTER (list = '{x}') AS {x}" for x in LISTS) + f" FROM (SELECT id, list, finding, min(pos) AS pos FROM {FINDING_ROWS.sql()} WHERE evaluated GROUP BY ALL) GROUP BY 1"

LEVELS = "(VALUES (1, 'CONFIRMED', false), (1, 'WEAK', false), (2, 'WEAK', false), (3, 'STRONG_EVIDENCE', true), (4, NULL, false), (5, 'POSSIBLE', false), (5, 'WEAK', false)) AS t(id, level, conflicting)"
LEVEL_ROWS = Rows(LEVELS, "lineitem", {"id": "1000 + l_orderkey", "level": pick("l_partkey", "WEAK", "POSSIBLE", "UNKNOWN", "CONFIRMED", "WEAK", "STRONG_EVIDENCE", None, "UNKNOWN", "WEAK"), "conflicting": "l_suppkey % 23 = 0"})


def confidence(spark, folder):
    levels = LEVEL_ROWS.frame(spark, folder).groupBy("id").agg(F.collect_set("level").alias("levels"), F.bool_or("conflicting").alias("conflicting"), F.count_if(F.col("level").isNull()).alias("unknowns"))
    known = rules.confidence(F.col("levels"), F.col("conflicting"))
    return levels.select("id", known.alias("confidence"), F.when(F.col("unknowns") > 0, "PARTIAL").otherwise("COMPLETE").alias("completeness"))


CONFIDENCE = f"""SELECT id, CASE WHEN bool_or(conflicting) THEN 'CONFLICTING' WHEN bool_or(coalesce(level IN ('CONFIRMED', 'STRONG_EVIDENCE'), false)) THEN 'STRONG_EVIDENCE' WHEN bool_or(coalesce(level = 'POSSIBLE', false)) THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS confidence,
  CASE WHEN bool_or(level IS NULL) THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM {LEVEL_ROWS.sql()} GROUP BY 1"""

NARRATIVES = """(VALUES (1, 'See [jd-1] and profile-0.', 'ev-9', 'ev-2'), (2, 'Only jd-7.', 'ev-9', 'ev-2'), (3, 'None.', 'a', 'b'), (4, 'A [jd-x] is malformed', 'ev-9', 'ev-2'), (5, 'xjd-1 jd-1x jd-1, (profile-0)jd-1 [profile-0][jd-1]', 'ev-9', 'ev-2'), (6, '[jd-3] is unknown', 'ev-9', 'ev-2'), (7, NULL, 'a', 'b')
) AS t(id, narrative, jd_1, profile_0)"""
NARRATIVE_ROWS = Rows(NARRATIVES, "documents", {"id": "1000 + doc_id", "narrative": "'[jd-1] ' || text || " + pick("doc_id", " profile-0", " jd-1 and profile-0.", " jd-2", " [profile-]"), "jd_1": "'ev-' || doc_id", "profile_0": "'profile-skills-0'"})


def citation_rewrite(spark, folder):
    names = F.create_map(F.lit("jd-1"), "jd_1", F.lit("profile-0"), "profile_0")
    out = NARRATIVE_ROWS.frame(spark, folder).select("id", matching.cited(F.col("narrative"), names).alias("c"))
    return out.select("id", F.when(F.col("id") < 1000, F.col("c.text")).otherwise(F.md5("c.text")).alias("narrative"), "c.violation")


_NAME = lambda x: f"CASE {x} WHEN 'jd-1' THEN jd_1 WHEN 'profile-0' THEN profile_0 END"
CITATION_REWRITE = f"""
WITH t AS (SELECT id, jd_1, profile_0, string_split(regexp_replace(narrative, '\\[((?:jd|profile)-[0-9]+)\\]', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM {NARRATIVE_ROWS.sql()}),
r AS (SELECT id, jd_1, profile_0, list_bool_or(list_transform(ps, lambda x, i: i % 2 = 0 AND x NOT IN ('jd-1', 'profile-0'))) AS lost,
  array_to_string(list_transform(ps, lambda x, i: CASE WHEN i % 2 = 0 THEN '[' || ({_NAME('x')}) || ']' ELSE x END), '') AS y FROM t),
k AS (SELECT *, regexp_extract_all(y, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+') AS ts FROM r),
v AS (SELECT *, CASE WHEN lost THEN 'unknown_evidence' WHEN regexp_matches(y, '\\[(?:jd|profile)-[^\\]]*\\]', 'i') THEN 'malformed_citation'
  WHEN len(list_filter(ts, lambda x: regexp_full_match(x, '(?:jd|profile)-[0-9]+') AND x NOT IN ('jd-1', 'profile-0'))) > 0 THEN 'unknown_evidence' END AS violation FROM k),
o AS (SELECT id, violation, CASE WHEN violation IS NULL THEN array_to_string(list_transform(ts, lambda x: coalesce({_NAME('x')}, x)), '') END AS narrative FROM v)
SELECT id, CASE WHEN id < 1000 THEN narrative ELSE md5(narrative) END AS narrative, violation FROM o"""

QUOTES = "(VALUES (1, 'We  do NOT own renewals', 'do not  own renewals'), (2, 'Owns renewals', 'renewals are not owned'), (3, 'a b', 'A  B'), (4, 'Renewals are handled by Sales', 'handled BY sales'), (5, 'x', NULL)) AS t(id, source, quote)"
QUOTE_ROWS = Rows(QUOTES, "documents", {"id": "1000 + doc_id", "source": "text", "quote": "CASE doc_id % 3 WHEN 0 THEN replace(substring(text, 11, 60), ' ', '  ') WHEN 1 THEN substring(text, 5, 40) ELSE 'not part of the role' END"})


def quote_grounding(spark, folder):
    """Whether a quote stands in its source but for case and white space, and says that something is left out."""
    plain = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"[ \t\n\r\f\x0b]+", " "), "^ | $", ""))
    inside = F.contains(plain(F.col("source")), plain(F.col("quote")))
    rows = QUOTE_ROWS.frame(spark, folder)
    return rows.select("id", inside.alias("grounded"), (inside & facts.has(plain(F.col("quote")), p.EXPLICIT_ABSENCE)).alias("excludes"))


QUOTE_GROUNDING = f"""SELECT id, contains(s, q) AS grounded, contains(s, q) AND regexp_matches(q, '\\b(?:does not|do not|will not|not responsible|not own|no responsibility|excluded|excluding|handled by|owned by|outside (?:the )?role|not part of)\\b') AS excludes
FROM (SELECT id, lower(regexp_replace(regexp_replace(source, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g')) AS s, lower(regexp_replace(regexp_replace(quote, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g')) AS q FROM {QUOTE_ROWS.sql()})"""


def end_to_end_recommendation(spark, folder):
    """Facts to criteria to the decision; the judged inputs are joined on."""
    filtered = _criteria(FACT_ROWS.frame(spark, folder)).select("id", rules.overall(*map(F.col, NAMED)).alias("overall"))
    judged = _judged(spark, folder).drop("overall")
    return _decided(filtered.join(judged, "id")).select("id", "overall", "decision", "skip_reasons", "review_reasons")


END_TO_END_RECOMMENDATION = _decide(f"(SELECT o.overall, r.* EXCLUDE (overall) FROM {_JUDGED} r JOIN ({HARD_FILTER_OVERALL}) o ON o.id = r.id)", "id, overall")

NAMES = (
    "cost_golden salary_facts location_facts travel_facts requirement_rows hard_filter_criteria hard_filter_overall text_normalize provenance_rows pricing_conflict override_merge request_gate "
    "compatibility_matrix requirement_match genuine_gaps match_violations preference_membership relationship_catalog maturity_dimensions profile_evidence posting_history signal_gate "
    "decision_precedence findings_rollup confidence quote_grounding end_to_end_recommendation citation_rewrite specialisation_cues relationship_restore requirement_eligible"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
