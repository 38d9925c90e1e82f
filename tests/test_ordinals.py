from pyspark.sql import functions as F

from sievework.operators import history
from sievework.operators.ordinals import PLACE_BITS, dealt, ordinals


def hot(spark, n=20_000):
    """A key with four fifths of the rows, a null key, small ones."""
    key = F.when(F.col("id") % 5 != 0, "hot").when(F.col("id") % 35 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1000))
    return spark.range(n).select(key.alias("key"), (F.col("id") * 7919 % 10007).alias("x"), "id", F.lit(1).alias("part_"), F.lit(2).alias("at_"))


def test_numbers_equal_a_window_over_each_key(spark):
    rows = hot(spark).repartition(7)
    got = {r.id: r.nth for r in ordinals(rows, ["key"], ["x", F.desc("id")]).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.key, []).append((r.x, -r.id, r.id))
    assert got == {i: n + 1 for members in groups.values() for n, (_, _, i) in enumerate(sorted(members))}


def test_without_keys_all_rows_are_numbered(spark):
    out = sorted((r.nth, r.x, r.id) for r in ordinals(hot(spark, 3000), [], ["x", "id"], "nth").collect())
    assert [n for n, *_ in out] == list(range(1, 3001)) and [x for _, *x in out] == sorted(x for _, *x in out)


def test_a_hot_key_is_spread_and_other_columns_stay(spark):
    rows = hot(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join ranges as small as these
    parts = dealt(rows, ["key"], ["x", "id"], "place").where("key = 'hot'").groupBy(F.shiftright("place", PLACE_BITS)).count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 0.7 * 16_000  # of four ranges
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ordinals(rows, ["key"], ["x", "id"]).columns == [*rows.columns, "nth"]
    plan = ordinals(rows, ["key"], ["x", "id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate" in window.split("Relation")[0]  # the window stands on a row a range and key, not on the rows


def test_ties_and_empty(spark):
    same = spark.createDataFrame([("a", 1)] * 50 + [(None, 1)] * 3, "key string, x int")
    assert sorted((r.key or "", r.nth) for r in ordinals(same, ["key"], ["x"]).collect()) == [("", n) for n in (1, 2, 3)] + [("a", n) for n in range(1, 51)]
    assert ordinals(same.where("x > 1"), ["key"], ["x"]).collect() == []


def test_claims_of_workers_are_disjoint_and_oldest_first(spark):
    tasks = spark.range(5000).select(
        F.col("id").alias("task_id"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 37 % 100 as int))").alias("created_at"), F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt"), F.lit(3).alias("max_attempts"), F.expr("timestamp '2024-01-02'").alias("now"), F.expr("timestamp '2024-01-01'").alias("available_at"), F.expr("cast(null as timestamp)").alias("lease_expires_at"),
    )
    got = history.claim_batches(tasks.where("task_id % 3 <> 0"), workers=7, each=11).collect()
    expected = sorted((i * 37 % 100, i) for i in range(5000) if i % 3)[: 7 * 11]
    assert sorted((r.nth * 7 + r.worker, r.task_id) for r in got) == [(k, i) for k, (_, i) in enumerate(expected)]
    few = history.claim_batches(tasks.where("task_id < 3"), workers=2, each=5).collect()
    assert sorted((r.worker, r.nth) for r in few) == [(0, 0), (0, 1), (1, 0)]
