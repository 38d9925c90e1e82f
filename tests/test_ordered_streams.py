import random
from datetime import datetime, timedelta

import pytest

from sievework.streaming.ordered import budgeted, leased, lease_step, settings

START = datetime(2024, 1, 1)
EVENTS = "task_id long, number long, at timestamp, kind string, retryable boolean"


def events(n, seed):
    rng = random.Random(seed)
    out = [(k % 6, k, START + timedelta(seconds=rng.randrange(400)), rng.choice(["CLAIM", "CLAIM", "CLAIM", "FAIL", "COMPLETE", "CREATE"]), rng.choice([True, True, False, None])) for k in range(n)]
    return [(t, -1 - t, START, "CREATE", None) for t in range(5)] + out  # the sixth task begins with whatever comes first


def run(spark, make, batches, folder, schema):
    """Each batch is a file; the query stops and starts again after the second. A row far ahead lets all others pass."""
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if n in (1, len(batches) - 1):
            stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
            stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def folded(rows, lease, attempts):
    """All events of each task at once, leases running out in between."""
    out = []
    for task in {r[0] for r in rows}:
        state = None
        own = sorted((r for r in rows if r[0] == task), key=lambda r: (r[2], r[1]))
        for k, (_, number, at, kind, retryable) in enumerate(own):
            while state and state[0] == "RUNNING" and state[4] + timedelta(milliseconds=1) < at and state[1] < state[2]:
                when = state[4] + timedelta(milliseconds=1)
                state, _ = lease_step(state, "EXPIRE", when, None, lease, attempts)
                out.append((task, None, "EXPIRE", True, *state[:2], state[5]))
            state, accepted = lease_step(state, kind, at, retryable, lease, attempts)
            out.append((task, number, kind, accepted, *state[:2], state[5]))
    return sorted(out, key=str)


def test_the_rules_of_a_lease():
    at, lease = START, timedelta(seconds=10)
    state, _ = lease_step(None, "CREATE", at, None, lease, 2)
    state, ok = lease_step(state, "CLAIM", at, None, lease, 2)
    assert ok and state[:2] == ("RUNNING", 1)
    assert not lease_step(state, "CLAIM", at + lease, None, lease, 2)[1]  # the lease must lie before the claim
    again, ok = lease_step(state, "CLAIM", at + 2 * lease, None, lease, 2)
    assert ok and again[:2] == ("RUNNING", 2) and again[5] == 1
    assert lease_step(again, "EXPIRE", at + 9 * lease, None, lease, 2) == (again, False)  # the last attempt stays running
    assert not lease_step(again, "CLAIM", at + 9 * lease, None, lease, 2)[1]
    assert lease_step(again, "FAIL", at, True, lease, 2)[0][0] == "FAILED" and lease_step(state, "FAIL", at, True, lease, 2)[0][0] == "PENDING"
    assert lease_step(state, "FAIL", at, False, lease, 2)[0][0] == "FAILED" and lease_step(state, "FAIL", at, None, lease, 2)[0][0] == "FAILED"
    done, ok = lease_step(state, "COMPLETE", at, None, lease, 2)
    assert ok and done[0] == "COMPLETED" and not lease_step(done, "CLAIM", at + 9 * lease, None, lease, 2)[1]


@pytest.mark.parametrize("seed", [1])
def test_a_stream_of_claims_equals_folding_all_at_once(spark, tmp_path, seed):
    settings(spark)
    rows = events(120, seed)
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    last = [(99, 999, START + timedelta(days=2), "CREATE", None), (99, 1000, START + timedelta(days=3), "CLAIM", None)]
    batches = [mixed[:30], mixed[30:60], mixed[60:], last[:1], last[1:]]
    out = run(spark, lambda s: leased(s, 30, 3, "1 hour"), batches, tmp_path, EVENTS).where("task_id <> 99").collect()
    got = sorted(((r.task_id, r.number, r.kind, r.accepted, r.status, r.attempt, r.interruptions) for r in out), key=str)
    expected = folded(rows, timedelta(seconds=30), 3)
    final = {task: [x for x in expected if x[0] == task] for task in range(6)}
    assert [x for x in got if x[2] != "EXPIRE"] == [x for x in expected if x[2] != "EXPIRE"]
    assert all(got.count(x) == expected.count(x) for x in expected) and all(final.values())


def test_budgets_equal_ordinals_for_any_split(spark, tmp_path):
    settings(spark)
    rng = random.Random(4)
    rows = [(k, k % 7, START + timedelta(seconds=rng.randrange(500))) for k in range(200)]
    mixed = rows[:]
    rng.shuffle(mixed)
    cuts = [0, 13, 90, 91, 200]
    batches = [mixed[a:b] for a, b in zip(cuts, cuts[1:])] + [[(5000, 77, START + timedelta(days=2))]]
    stored = spark.createDataFrame([(0, 25), (3, 39)], "evaluation_id long, calls long")
    out = run(spark, lambda s: budgeted(s, 40, "1 hour", stored), batches, tmp_path, "event_id long, evaluation_id long, ts timestamp").collect()
    began, expected = {0: 25, 3: 39}, set()
    for event, evaluation, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        before = began.get(evaluation, 0)
        began[evaluation] = before + 1
        expected.add((event, evaluation, before, before < 40))
    assert {tuple(r) for r in out if r.event_id != 5000} == expected and any(not r.allowed for r in out)
