from sievework.operators.opportunities import contract_violations


def test_contract_violations_in_one_grouping_of_bounded_parts(spark):
    evidence = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (2, None), (3, None)]
    against = [(1, ["a"], ["c"]), (1, ["c"], ["b"]), (2, ["b"], []), (3, [None], ["a"]), (4, ["z"], ["z"]), (None, ["a"], None)]
    given = spark.createDataFrame(evidence, "stage_id long, reference_id string")
    told = spark.createDataFrame(against, "stage_id long, refs_a array<string>, refs_b array<string>")
    twice = [(1, "duplicate_reference", "a"), (2, "duplicate_reference", None)]
    unknown = [(s, "unknown_reference", r) for s, r in [(1, "c"), (2, "b"), (3, None), (3, "a"), (4, "z")]]
    for parts in (None, 7):
        out = contract_violations(given, told, parts)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        assert parts is None or f", {parts})" in plan
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, twice + unknown))
