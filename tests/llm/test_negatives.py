import math

import numpy as np
import pytest

from sievework.llm.negatives import Search, Tree, mine_hard_negatives

INF = float("inf")


def clusters(n, d=8, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, d))
    return (middles[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, d))) * rng.uniform(0.5, 2, (n, 1))


def test_bounds_of_leaves_hold_every_row():
    rows = np.floor(256 * clusters(3000))
    most = float((rows**2).sum(1).max())
    tree, queries = Tree(rows, most, 100), rows[::300]
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(3000))
    least, greatest = tree.bounds(queries, most)
    for a, q in enumerate(queries):
        for f, leaf in enumerate(tree.leaves):
            away = np.sqrt(np.maximum((q**2).sum() + most - 2 * rows[leaf] @ q, 0))
            assert (away >= least[a, f] - 1e-6).all() and (away <= greatest[a, f] + 1e-6).all()


def test_clustered_rows_are_mostly_pruned():
    rows = clusters(4096)
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    most = float((rows**2).sum(1).max())
    ids, labels = np.arange(4096), np.arange(4096) % 10
    some = np.arange(0, 4096, 100)
    n = len(some)
    search = Search(ids[some], labels[some], rows[some], np.arange(n), True, np.full(n, -(1 << 62)), np.full(n, 1 << 62), 5, most)
    scored = search.visit(ids, np.zeros(4096, bool), labels, Tree(rows, most, 64))
    assert scored < 0.5 * n * 4096
    for a in range(n):
        scores = rows @ rows[some[a]]
        own = sorted((-int(scores[i]), i) for i in range(4096) if labels[i] == labels[some[a]] and i != some[a])[:5]
        at = search.found[0] == a
        assert [(-s, i) for s, i in zip(search.found[1][at].tolist(), search.found[3][at].tolist())] == own


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    sizes = {}
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for _, v, _ in good:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    if not sizes:
        return []
    size = min(sizes, key=lambda s: (-sizes[s], s))
    good = [r for r in good if len(r[1]) == size]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, q, label in good:
        if a is None or a % every:
            continue
        scores = [(sum(x * y for x, y in zip(q, v)), i, y) for i, v, y in good]
        for ps, p, _ in sorted((s for s in scores if s[2] == label and s[1] != a), key=key)[:positives]:
            window = sorted((s for s in scores if s[2] != label and s[1] != a and low * ps <= 100 * s[0] <= high * ps), key=key)[:negatives]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i, _) in enumerate(window)]
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, id int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, y, 1, "x") for i, v, y in rows], SCHEMA)


def exact(rows):
    """As 32-bit floats hold them."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("block_rows,tasks", [(4096, 1024), (300, 3), (64, 1)])
def test_equals_brute_force(spark, block_rows, tasks):
    rows = exact([(i, v.tolist(), i * i % 7) for i, v in enumerate(clusters(1500))])
    for i in range(0, 1500, 4):  # a vector that very many rows have
        rows[i] = (i, rows[4][1], i % 7)
    rows += exact([(2000, None, 1), (2001, [1.0] * 8, None), (2100, [1.0] * 7 + [None], 1), (2200, [INF] + [1.0] * 7, 1), (2300, [float("nan")] * 8, 1), (2400, [1.0] * 5, 1), (2500, [], 1)])
    rows += exact([(2600, [0.0] * 8, 1), (-100, (-np.ones(8)).tolist(), 2), (None, rows[100][1], 3), (None, rows[100][1], rows[100][2]), (700, rows[300][1], 5), (2700, [50.0] * 8, 6)])
    got = mine_hard_negatives(frame(spark, rows).repartition(3), block_rows=block_rows, tasks=tasks).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_few_rows_one_label_and_none(spark):
    alone = exact([(0, [1.0, 2.0], 1)])
    assert mine_hard_negatives(frame(spark, alone)).collect() == []
    one = exact([(i, [1.0, float(i)], 1) for i in range(5)])
    assert mine_hard_negatives(frame(spark, one)).collect() == []
    few = exact([(0, [1.0, 0.0], 1), (1, [1.0, 5.0], 1), (2, [0.5, 5.0], 2), (3, [0.95, 5.0], 2), (4, [0.3, 1.0], 2)])
    assert sorted((tuple(r) for r in mine_hard_negatives(frame(spark, few)).collect()), key=str) == brute(few)
    assert mine_hard_negatives(frame(spark, [])).collect() == []


def test_large_components_stay_exact(spark):
    rows = exact([(i, [float(2**20 + i), float(2**21 - 3 * i), 1.0], i % 3) for i in range(400)])
    assert sorted((tuple(r) for r in mine_hard_negatives(frame(spark, rows), low=99, high=100).collect()), key=str) == brute(rows, low=99, high=100)
    with pytest.raises(ValueError):
        mine_hard_negatives(frame(spark, exact([(0, [1e30, 1.0], 1)])))
