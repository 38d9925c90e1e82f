import pytest

from sievework.llm.mixing import mix_sources


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, {s for s in sizes if sizes[s]}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        for s in full or open_:
            target[s] = epochs * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    return {s: target.get(s, 0.0) for s in sizes}


def rows(spark, n=3000):
    out = []
    for i in range(n):
        source = ["a", "B", None, "é", "hot", "hot", "hot", "tiny"][i % 8 if i % 8 != 7 or i < 60 else 5]
        out.append((i, None if i % 97 == 0 else "w " * (1 + i * i % 211), source, 1, 2))
    out += [(n, None, "void"), (n + 1, "", "void")]
    return spark.createDataFrame([(*r[:3], 1, 2) for r in out], "doc_id long, text string, source string, size int, target int")


def test_targets_and_draws(spark):
    out = mix_sources(rows(spark)).collect()
    assert len(out) == 3002 and len({r.doc_id for r in out}) == 3002
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.times * r.size <= 2 * r.size
    target = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 30


@pytest.mark.parametrize("weights", [(3, 1, 2), (1,), (9, 1)])
def test_many_sources(spark, weights):
    docs = [(i, "w " * (1 + (s * s * 7) % 90), f"s{s:02}") for s in range(25) for i in range(s * 100, s * 100 + 4 + s)]
    out = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights).collect()
    target = brute_targets({r.source: r.source_size for r in out}, weights)
    assert {r.source: r.target for r in out} == pytest.approx(target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in out))


def test_carried_columns(spark):
    out = mix_sources(rows(spark), carry=("text", "size")).where("doc_id = 8").first()
    assert out.row.text == "w " * 65 and out.row.size == 1 and out.size == 65


def test_reruns_agree(spark):
    one = sorted((r.doc_id, r.taken) for r in mix_sources(rows(spark)).collect())
    assert one == sorted((r.doc_id, r.taken) for r in mix_sources(rows(spark).repartition(7)).collect())


def test_infeasible_share_stops_at_the_caps(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mix_sources(docs, share=9.0).collect()) == [(1, 4.0, 4), (2, 2.0, 2)]


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    out = mix_sources(spark.createDataFrame([(1, "a b", None)] * 4 + [(None, "c", None)], schema)).collect()
    assert len(out) == 5 and {r.source_size for r in out} == {9}


def test_a_very_long_text_and_other_columns(spark):
    """A text with most of its source's words is taken whole or not at all; other columns, whatever their names, are ignored."""
    docs = [(1, "w " * 500_000, "x"), (2, "a b c", "x"), (3, "d", "y")]
    plain = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    more = mix_sources(spark.createDataFrame([(*d, 7, 8, "z", 9.0) for d in docs], "doc_id long, text string, source string, times int, taken int, draw string, TARGET double")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, more)) and {r.doc_id: r.size for r in plain} == {1: 500_000, 2: 3, 3: 1}
    assert all(r.taken in (r.size, 2 * r.size) for r in plain if r.doc_id == 1)
