import pytest
from pyspark.sql import functions as F

from sievework.operators import contexts
from sievework.plans import table_queries as q
from sievework.plans.gates import ContractViolated, Gate, gated
from sievework.plans.stages import Pipeline, Stage



def rules():
    return {"no_name": F.col("name").isNull(), "negative": F.col("x") < 0, "large": F.col("x") > 90}


def rows(spark):
    return spark.range(200).select("id", F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 7 != 0, F.col("id") % 100 - 5).alias("x"))


def test_one_scan_counts_and_sets_aside(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    frame = rows(spark).mapInArrow(seen, "id long, name string, x long")
    kept, counts = Gate("g", rules()).passed(frame, str(tmp_path / "g"))
    every = rows(spark).collect()
    broken = {r.id: [k for k, b in (("no_name", r.name is None), ("negative", r.x is not None and r.x < 0), ("large", r.x is not None and r.x > 90)) if b] for r in every}
    assert counts == {"rows": 200, "any": sum(map(bool, broken.values())), **{k: sum(k in b for b in broken.values()) for k in rules()}}
    assert reads.value == 200
    assert {r.id for r in kept.collect()} == {i for i, b in broken.items() if not b} and kept.columns == frame.columns
    assert {(r.id, r.violation) for r in Gate("g", rules()).set_aside(spark, str(tmp_path / "g")).collect()} == {(i, b[0]) for i, b in broken.items() if b}


def test_a_gate_shuts_by_policy_and_its_stage_fails(spark, tmp_path):
    with pytest.raises(ContractViolated) as e:
        Gate("g", rules(), fatal=frozenset({"negative"})).passed(rows(spark), str(tmp_path / "a"))
    assert e.value.counts["negative"] > 0
    with pytest.raises(ContractViolated):
        Gate("g", rules(), most=0.05).passed(rows(spark), str(tmp_path / "b"))
    make = lambda **more: [gated(Stage("first", lambda s, d: rows(s)), Gate("g", rules(), **more), str(tmp_path / "c")), Stage("next", lambda s, d: d["first"].where("x is null"))]
    _, log = Pipeline(make(most=0.0)).run(spark, str(tmp_path / "p1"))
    assert [r["status"] for r in log] == ["FAILED", "PENDING"] and "ContractViolated" in log[0]["error"]
    results, log = Pipeline(make()).run(spark, str(tmp_path / "p2"))
    assert [r["status"] for r in log] == ["COMPLETED", "COMPLETED"] and results["next"].count() == sum(1 for i in range(200) if i % 7 == 0 and i % 10 != 0)
    assert Gate("g", rules()).passed(rows(spark).limit(0), str(tmp_path / "d"))[0].count() == 0


def test_expanded_chains_equal_the_whole_contexts(spark):
    folder = "/root/testdata/sf0.001"
    stages = q._stages(spark, folder)
    chain = contexts.chained(stages)
    assert chain.count() == stages.count()
    got = {(r.evaluation_id, r.position): r.context for r in contexts.expanded(chain, stages).collect()}
    assert got == {(r.evaluation_id, r.position): r.context for r in q.stage_context(spark, folder).collect()}
    at = {(r.evaluation_id, r.position): r for r in chain.collect()}
    for (e, p), r in list(at.items())[:200]:  # the pointers lead through the same list
        found, now = [], r.parent
        while now is not None:
            found.append(at[e, now].delta)
            now = at[e, now].parent
        assert ">".join(reversed(found)) == got[e, p] and r.nth == len(found)
