"""Boundary cases, typed in by hand."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import columns as c
from sievework.functions import facts, rules


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("days", "name"),
    [(0, "HIGHEST_PRIORITY"), (3, "HIGHEST_PRIORITY"), (4, "STRONG_PRIORITY"), (7, "STRONG_PRIORITY"), (8, "GOOD_OPPORTUNITY"), (14, "GOOD_OPPORTUNITY"), (15, "REVIEW"), (21, "REVIEW"), (22, "CAUTION"), (90, "CAUTION"), (None, "UNKNOWN")],
)
def test_age_classes(spark, days, name):
    assert value(spark, c.age_class(F.lit(days).cast("int"))) == name


def test_missing_and_future_dates_have_no_age(spark):
    for posted in ("2026-01-02", None):
        assert value(spark, c.posting_age(F.lit("2026-01-01").cast("date"), F.lit(posted).cast("date"))) is None


def test_band_edges(spark):
    got = [value(spark, c.band(F.lit(s), "resume_match")) for s in (0, 19, 20, 39, 40, 59, 60, 79, 80, 100)]
    assert got == [n for n in c.BANDS["resume_match"] for _ in range(2)]
    assert value(spark, c.band(F.lit(101), "maturity")) is None


@pytest.mark.parametrize(
    ("low", "country", "us", "want"),
    [(60_000, None, True, "PASS"), (59_999, None, True, "REVIEW"), (55_000, None, True, "REVIEW"), (54_999, None, True, "FAIL"), (50_000, "Portugal", False, "PASS"), (50_000, "France", False, "REVIEW")],
)
def test_salary_lines(spark, low, country, us, want):
    got = rules.salary_criterion(F.lit("DISCLOSED"), F.lit(low), F.lit(low), F.lit(us), F.lit(False), F.lit(country).cast("string"), ["Portugal"])
    assert value(spark, got) == want


@pytest.mark.parametrize(("text", "amount"), [("$70000", 700), ("$1,200", None), ("$60k", 60_000), ("$ 54,999", 54_999)])
def test_money(spark, text, amount):
    assert value(spark, facts.money(F.lit(text))) == amount


def test_infrequent_counts_as_recurring(spark):
    assert value(spark, rules.travel_criterion(F.lit("COMPANY_EVENT"), F.lit("infrequent"), True, True)) == "REVIEW"
    assert value(spark, rules.travel_criterion(F.lit("CUSTOMER_ONSITE"), F.lit("monthly"), True, True)) == "FAIL"


def test_text_without_anything_visible_is_null(spark):
    assert value(spark, c.normal_text(F.lit("   \t"))) is None
    assert value(spark, c.normal_text(F.lit("　a b﻿"))) == "a b"


def test_citations(spark):
    from sievework.operators.matching import cited
    from sievework.plans.case_queries import NARRATIVES

    names = F.create_map(F.lit("jd-1"), "jd_1", F.lit("profile-0"), "profile_0")
    rows = spark.sql(f"SELECT * FROM {NARRATIVES}").select("id", cited(F.col("narrative"), names).alias("c")).select("id", "c.*").collect()
    assert {r.id: (r.text, r.violation) for r in rows} == {
        1: ("See [ev-9] and ev-2.", None), 2: (None, "unknown_evidence"), 3: ("None.", None), 4: (None, "malformed_citation"), 5: ("xjd-1 jd-1x ev-9, (ev-2)ev-9 [ev-2][ev-9]", None), 6: (None, "unknown_evidence"), 7: (None, None),
    }


def test_an_indented_bullet_stays(spark):
    text = F.lit("First.\n  - Indented is required\n- Bare is required")
    assert value(spark, facts.requirements(text)) == ["- Indented is required", "Bare is required"]


def test_references_of_a_row_are_rewritten_once(spark):
    from sievework.operators import opportunities as op

    rows = [(1, '{"evidenceReferences":["a"]}'), (2, '{"evidenceReferences":["b"]}'), (3, '{"evidenceReferences":"a"}'), (4, None)]
    names = F.create_map(F.lit("a"), F.lit("stored"))
    out = spark.createDataFrame(rows, "id int, body string").select("id", op.rewritten(F.col("body"), names).alias("r")).select("id", "r.*")
    assert [(r.json, r.violation) for r in out.orderBy("id").collect()] == [('{"evidenceReferences":["stored"]}', None), (None, "unknown_reference"), (None, "malformed_references"), (None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(body#") == 1


def test_texts_without_a_match_are_not_split(spark):
    from sievework.functions import facts, patterns

    rows = [(1, "Nothing. At all."), (2, "One.\nFully remote. Degree required."), (3, None), (4, "time\nzone")]
    frame = spark.createDataFrame(rows, "id int, t string")
    out = frame.select("id", facts.first_matching_sentence(F.col("t"), patterns.PLACE).alias("s"), facts.requirements(F.col("t")).alias("r"))
    assert [(r.s, r.r) for r in out.orderBy("id").collect()] == [(None, []), ("Fully remote.", ["Degree required."]), (None, None), (None, [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(t#") == 2 and "CASE WHEN RLIKE(t#" in plan
