import json
import random

from pyspark.sql import functions as F

from sievework.operators import json_trees
from sievework.operators.json_trees import canonical_json, levels, rewrite_references
from sievework.operators.opportunities import REFERENCE_KEYS

WORDS = ["a", "B", "b", "Ab", "aB", "zeta", "é", "10", "9", "_x", 'quo"te', "back\\slash", "line\nbreak", '","evidenceReferences":["jd-0"]', ""]


def tree(rng, depth):
    kind = rng.randrange(5 if depth else 3)
    if kind == 0:
        return rng.choice(WORDS)
    if kind == 1:
        return rng.choice([0, -7, 12345678901, True, False, None, 1.5, 0.25])
    if kind == 2:
        return {} if rng.random() < 0.5 else []
    if kind == 3:
        return [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    out = {rng.choice(WORDS): tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if rng.random() < 0.4:
        out[rng.choice(REFERENCE_KEYS)] = rng.choice([["jd-0"], ["jd-0", "profile-1", "jd-0"], [], ["nobody"], "jd-0", [1], ["jd-0", ["jd-0"]], {"jd-0": "jd-0"}] if rng.random() < 0.4 else [["jd-0"], ["profile-1", "jd-0"], []])
    return out


def shuffled(rng, x):
    if isinstance(x, dict):
        keys = list(x)
        rng.shuffle(keys)
        return {k: shuffled(rng, x[k]) for k in keys}
    return [shuffled(rng, y) for y in x] if isinstance(x, list) else x


def walk(x, names, wrong):
    if isinstance(x, list):
        return [walk(y, names, wrong) for y in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if k in REFERENCE_KEYS:
            if not isinstance(v, list) or any(not isinstance(r, str) for r in v):
                wrong.add("malformed_references")
            else:
                wrong.update("unknown_reference" for r in v if r not in names)
                out[k] = [names.get(r) for r in v]
        else:
            out[k] = walk(v, names, wrong)
    return out


def test_key_orders_of_one_document_give_one_hash(spark):
    rng = random.Random(11)
    docs = [tree(rng, 5) for _ in range(80)]
    rows = [(i * 10 + k, json.dumps(shuffled(rng, d), ensure_ascii=k % 2 == 0, indent=k)) for i, d in enumerate(docs) for k in range(3)]
    out = {r.id: r for r in canonical_json(spark.createDataFrame(rows, "id long, json string").repartition(3)).collect()}
    assert len(out) == len(rows)
    for i, d in enumerate(docs):
        assert len({out[i * 10 + k].content_hash for k in range(3)}) == 1
        assert json.loads(out[i * 10].json) == d
    assert len({r.json for r in out.values()}) == len({json.dumps(d, sort_keys=True) for d in docs})


def test_keys_are_ordered_by_collation(spark):
    rows = [(1, '{"b":1,"B":2,"a":3,"_":4,"Ab":5,"10":6,"9":7,"aB":8}'), (2, '{"n":1.50,"m":1.0,"l":[2,1]}'), (3, "no json"), (4, None), (5, '"x"'), (6, "[]"), (7, '{"a":1,"a":2}')]
    out = {r.id: r.json for r in canonical_json(spark.createDataFrame(rows, "id int, json string")).collect()}
    assert out == {1: '{"_":4,"10":6,"9":7,"a":3,"aB":8,"Ab":5,"b":1,"B":2}', 2: '{"l":[2,1],"m":1,"n":1.5}', 3: None, 4: None, 5: '"x"', 6: "[]", 7: None}


def test_references_are_rewritten_as_by_a_walk(spark):
    rng = random.Random(5)
    docs = [tree(rng, 6) for _ in range(300)]
    names = {"jd-0": 'stored "a"', "profile-1": "stored-é"}
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{"), (-2, None)]
    frame = spark.createDataFrame(rows, "id long, json string")
    out = {r.id: r for r in rewrite_references(frame, spark.createDataFrame(list(names.items()), "reference string, stored string"), REFERENCE_KEYS).collect()}
    kinds = set()
    for i, d in enumerate(docs):
        wrong = set()
        expected = walk(d, names, wrong)
        assert out[i].violation == (min(wrong) if wrong else None), (d, out[i])
        kinds.add(out[i].violation)
        assert out[i].json is None if wrong else json.loads(out[i].json) == expected
    assert kinds == {None, "malformed_references", "unknown_reference"} and out[-1].violation == out[-2].violation == "not_json"


def test_names_of_each_document_and_depth(spark):
    deep = '{"x":[' * 5 + '{"evidenceReferences":["r"]}' + "]}" * 5
    frame = spark.createDataFrame([(1, deep), (2, deep), (3, deep)], "id int, json string")
    names = spark.createDataFrame([(1, "r", "one"), (2, "r", "two"), (3, "q", "no")], "id int, reference string, stored string")
    out = {r.id: (r.json, r.violation) for r in rewrite_references(frame, names, ["evidenceReferences"]).collect()}
    assert out == {1: (deep.replace('"r"', '"one"'), None), 2: (deep.replace('"r"', '"two"'), None), 3: (None, "unknown_reference")}
    assert len(levels(frame.where(F.col("id") == 1))) == 13


def test_no_table_of_documents_or_nodes_is_broadcast(spark, monkeypatch):
    """Small files may hold very many rows, which the driver would have to hold."""
    plans, write = {}, json_trees.materialise

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(json_trees, "materialise", noted)
    docs = spark.createDataFrame([(1, '{"b":[1,{"evidenceReferences":["x"]}],"a":{}}'), (2, "no"), (None, "{}")], "id long, json string")
    out = canonical_json(docs)
    plans["canonical"] = out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.json for r in out.collect()} == {1: '{"a":{},"b":[1,{"evidenceReferences":["x"]}]}', 2: None, None: None}
    names = spark.createDataFrame([("x", "y")], "reference string, stored string")
    found = {r.id: (r.json, r.violation) for r in rewrite_references(docs, names, REFERENCE_KEYS).collect()}
    assert found == {1: ('{"a":{},"b":[1,{"evidenceReferences":["y"]}]}', None), 2: (None, "not_json"), None: (None, "not_json")}
    assert not [n for n in ("level", "canonical", "rewritten") if "Broadcast" in plans[n]]
