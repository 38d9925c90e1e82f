import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import accounting
from sievework.plans.stages import Domain, Pipeline, Stage, outcome
from sievework.sources import tables
from sievework.streaming.attempts import drain, priced_stream


def test_stages_resume_retry_and_stop(spark, tmp_path):
    calls = {"a": 0, "b": 0}

    def a(spark, done):
        calls["a"] += 1
        return spark.range(3)

    def b(spark, done):
        calls["b"] += 1
        if calls["b"] < 3:
            raise RuntimeError("not yet")
        return done["a"].withColumn("x", F.col("id") * 2)

    stages = [Stage("a", a), Stage("b", b, max_attempts=2), Stage("c", lambda s, d: d["b"])]
    _, log = Pipeline(stages).run(spark, str(tmp_path))
    assert [r["status"] for r in log] == ["COMPLETED", "FAILED", "PENDING"] and log[1]["attempt"] == 2
    assert outcome(log) == "FAILED: b, c"
    results, log = Pipeline(stages).run(spark, str(tmp_path))
    assert outcome(log) == "COMPLETED" and calls["a"] == 1 and results["c"].agg(F.sum("x")).first()[0] == 6


def test_a_failure_may_be_passed_over(spark, tmp_path):
    stages = [Stage("bad", lambda s, d: 1 / 0, on_failure="CONTINUE"), Stage("good", lambda s, d: s.range(1))]
    _, log = Pipeline(stages).run(spark, str(tmp_path))
    assert [r["status"] for r in log] == ["FAILED", "COMPLETED"]


@pytest.mark.parametrize("ids", [[], ["x", "x"], [""]])
def test_bad_definitions_are_refused(ids):
    with pytest.raises(ValueError):
        Pipeline([Stage(i, None) for i in ids])


def test_submissions_and_raw_records(spark, tmp_path):
    rows = [
        {"rawText": "Lead", "postingDate": "2026-02-28", "domain": "field-service"}, {"rawText": "  "}, {"rawText": "x", "postingDate": "2026-02-30"},
        {"rawText": "x", "postingDate": "08/12/2026"}, {"rawText": "x", "other": 1}, {"rawText": "x", "sourceUrl": "nope"}, {"rawText": "x", "domain": "Bad Slug"},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json")
    out = tables.submissions(spark, str(tmp_path / "in.json"))
    assert [r.violation for r in out.collect()] == [None, "text_required", "date", "date", "unknown_key", "url", "domain", "not_an_object"]
    raw = tables.raw_records(out.where("violation is null"), "2026-01-01")
    tables.append(raw, str(tmp_path / "raw"))
    tables.append(raw, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_stream_prices_each_file_once(spark, tmp_path):
    from sievework.plans.table_queries import PRICES

    events = spark.createDataFrame([(i, None, 1, "view", 3.7, '{"k": 9}') for i in range(4)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    prices = spark.sql(f"SELECT * FROM {PRICES}")
    for times in (1, 2):
        events.coalesce(1).write.mode("append").parquet(folder)
        drain(priced_stream(spark, folder, events.schema, prices), out, check)
        found = spark.read.parquet(out)
        assert found.count() == 4 * times and found.where("cost is null").count() == 0
    batch = accounting.priced(accounting.attempts_of_events(events), prices)
    assert round(batch.agg(F.sum("cost")).first()[0] * 2, 12) == round(found.select(F.sum(F.col("cost").cast("decimal(30,12)"))).first()[0], 12)


def test_a_stage_sees_all_completed_stages_before_it(spark, tmp_path):
    from sievework.plans.registry import QUERIES

    rows = [(1, i, ["view", "click"][i % 2], 5.0 if i % 10 == 9 else 50.0) for i in range(60)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.position: r for r in QUERIES["stage_context"](spark, str(tmp_path)).collect()}
    for _, i, *_ in rows:
        assert found[i].before == i and found[i].context == ">".join(t for _, j, t, v in rows if j < i and v >= 10)


def test_a_domain_ends_in_a_result_and_a_recommendation(spark, tmp_path):
    stages = [Stage("a", lambda s, d: s.range(3)), Stage("b", lambda s, d: d["a"].withColumn("x", F.col("id") * 2))]
    domain = Domain("field", {"rules": "1"}, stages, ["id", "x"], lambda s, d: d["b"], lambda r: r.where("x > 2").select("id"))
    result, recommended, log = domain.evaluate(spark, str(tmp_path / "one"))
    assert result.count() == 3 and [r.id for r in recommended.collect()] == [2] and outcome(log) == "COMPLETED"
    with pytest.raises(ValueError):
        Domain("field", {}, stages, ["id"], lambda s, d: d["b"]).evaluate(spark, str(tmp_path / "one"))
    broken = Domain("field", {}, [Stage("bad", lambda s, d: 1 / 0)], [], lambda s, d: None)
    assert broken.evaluate(spark, str(tmp_path / "two"))[0] is None
