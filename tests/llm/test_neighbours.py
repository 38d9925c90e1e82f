from pathlib import Path

import numpy as np
import pytest

from sievework.llm import neighbours
from sievework.llm.neighbours import near_cells, search

FOLDER = "/root/testdata/sf0.1"


def brute(rows, every=20, k=20):
    usable = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    for q in usable:
        if q % every == 0:
            scores = sorted(((-(usable[q] * v).sum(), i) for i, v in usable.items() if i != q))[:k]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(scores))


def make(spark, n=1500, copies=40):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[40][1]) for i in range(copies)]
    rows += [(20_000, None), (20_020, [0.0] * 8), (20_040, [1.0] * 7 + [None]), (20_060, [float("nan")] + [1.0] * 7), (20_080, [float("inf")] + [1.0] * 7), (20_100, [1.0]), (None, [1.0] * 8)]
    return rows, spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")


def test_recall_ranks_and_scores(spark):
    rows, frame = make(spark)
    out = sorted(tuple(r) for r in search(frame, ).collect())
    truth = sorted(brute([r for r in rows if r[0] is not None]))
    assert len(out) == len(truth) and [r[:2] for r in out] == [r[:2] for r in truth]
    got, want = {(r[0], r[2]): r[3] for r in out}, {(r[0], r[2]): r[3] for r in truth}
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[x] - want[x]) < 1e-12 for x in got.keys() & want.keys())


def test_everything_probed_is_exact_however_cells_are_cut(spark):
    rows, frame = make(spark, 300)
    truth = [r[:3] for r in sorted(brute([r for r in rows if r[0] is not None]))]
    for unit in (4096, 7):
        assert [tuple(r)[:3] for r in sorted(search(frame, recall=1.0, unit_rows=unit).collect())] == truth


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).count() == 0
    assert search(spark.createDataFrame([(20, [1.0, 2.0])], schema)).count() == 0
    out = search(spark.createDataFrame([(20, [1.0, 2.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert sorted(tuple(r) for r in out) == [(20, 1, 2, 1.0), (20, 2, 3, 1.0)]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_recall_on_the_table(spark):
    """Every query of the table with default settings, against brute force."""
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if r.embedding is not None and None not in r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    found = {}
    for r in search(frame).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = (x * x[at]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != at][:20]
        own = sorted(found[ids[at]])
        assert len(own) == 20 and [r for r, *_ in own] == list(range(1, 21))
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in own)
        hits, total = hits + len({i for _, i, _ in own} & set(ids[order].tolist())), total + 20
    assert hits >= 0.9 * total


def test_cells_come_in_order(monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 1)
    rng = np.random.default_rng(1)
    left, right, q = rng.normal(size=(6, 4)), rng.normal(size=(5, 4)), rng.normal(size=8)
    sizes = np.ones(30, int)
    out = near_cells(q, left, right, sizes, 30)
    sums = [left[c // 5] @ q[:4] + right[c % 5] @ q[4:] for c in out]
    assert sorted(out) == list(range(30)) and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))
