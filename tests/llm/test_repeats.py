import hashlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import repeats, substrings
from sievework.llm.substrings import substring_dedup
from sievework.llm.suffixes import suffix_dedup

SCHEMA = "doc_id long, text string, d int, payload string"


def corpus():
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.integers(400))}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "short text", "a " * 200, "x" * 300, "ab " * 40, "é" * 120, "é" * 121]
    for i in range(25):
        own = [word() for _ in range(int(rng.integers(20, 200)))]
        at = int(rng.integers(len(own)))
        if i % 2:
            cut = int(rng.integers(0, 30))
            own[at:at] = passage[cut : 60 - int(rng.integers(0, 20))]
        texts.append(("\t" if i % 3 else " ").join(own))
    texts += [texts[12], texts[12] + " more", texts[15].replace(" ", "  "), " ".join(passage)]
    ids = list(np.random.default_rng(6).permutation(len(texts)))
    return [(int(i), t) for i, t in zip(ids, texts)]


def brute_words(rows, size):
    count, split = Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[a : a + size]) for a in range(len(w) - size + 1))
    for i, w in split:
        out = [False] * len(w)
        for a in range(len(w) - size + 1):
            if count[tuple(w[a : a + size])] > 1:
                out[a : a + size] = [True] * size
        yield i, len(w), sum(out), hashlib.sha256(b" ".join(x for x, o in zip(w, out) if not o)).hexdigest()


def brute_bytes(rows, size):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - size + 1):
            least[b[a : a + size]] = min(i, least.get(b[a : a + size], i))
    for i, t in rows:
        b = (t or "").encode()
        out = [False] * len(b)
        for a in range(len(b) - size + 1):
            if least[b[a : a + size]] < i:
                out[a : a + size] = [True] * size
        spans = sum(1 for k, o in enumerate(out) if o and not (k and out[k - 1]))
        yield i, len(b), sum(out), spans, hashlib.sha256(bytes(x for x, o in zip(b, out) if not o)).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p") for i, t in rows], SCHEMA)


def test_words_match_brute_force(spark):
    rows = corpus()
    out = sorted(tuple(r) for r in substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert out == sorted(brute_words(rows, 35))
    assert any(r[2] for r in out) and any(r[1] and not r[2] for r in out)


def test_bytes_match_brute_force(spark):
    rows = corpus()
    out = sorted(tuple(r) for r in suffix_dedup(frame(spark, rows)).drop("kept").collect())
    assert out == sorted(brute_bytes(rows, 50))


@pytest.mark.parametrize("block, segment", [(64, 8), (2000, 100), (1 << 22, 16)])
def test_small_blocks_and_segments_give_the_same_rows(spark, monkeypatch, block, segment):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)  # 64: every longer text comes in pieces
    monkeypatch.setattr(repeats, "SEGMENT_KEYS", segment)
    test_words_match_brute_force(spark)
    test_bytes_match_brute_force(spark)


@pytest.mark.parametrize("texts, windows", [(0, 200_000), (1, 10), (4096, 1)])
def test_buckets_of_any_size_give_the_same_rows(spark, monkeypatch, texts, windows):
    monkeypatch.setattr(repeats, "BUCKET_TEXTS", texts)  # 0: all windows are grouped by their hashes
    monkeypatch.setattr(repeats, "BLOCK_WINDOWS", windows)
    monkeypatch.setattr(repeats, "SEGMENT_TEXTS", 8)
    test_bytes_match_brute_force(spark)


def test_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats.Sketch, "answer", staticmethod(lambda c, most: np.ones(len(c[0]), np.uint8)))  # all estimated as repeated
    test_words_match_brute_force(spark)


@pytest.mark.parametrize("operator, brute", [(substring_dedup, brute_words), (suffix_dedup, brute_bytes)])
def test_very_long_text(spark, operator, brute):
    rng = np.random.default_rng(8)
    long = " ".join(f"w{x}" for x in rng.integers(3000, size=60_000))
    rows = [(1, long[:2000]), (2, long), (3, long[150_000:200_000] + " tail"), (4, "other words")]
    out = sorted(tuple(r) for r in operator(frame(spark, rows)).drop("kept", "text").collect())
    assert out == sorted(brute(rows, 35 if operator is substring_dedup else 50))


def test_merged_runs():
    doc, at, count = (np.array(x) for x in ([1, 1, 1, 2, 2], [0, 3, 9, 0, 1], [3, 2, 1, 5, 1]))
    assert [x.tolist() for x in repeats.merged(doc, at, count)] == [[1, 1, 2], [0, 9, 0], [5, 1, 5]]


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_empty_table_and_repeated_ids(spark, operator):
    assert operator(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    out = operator(frame(spark, [(1, text), (1, text), (None, text), (2, None)])).select("doc_id", "n_removed").collect()
    size = len(text) if operator is suffix_dedup else 60
    kept = 0 if operator is suffix_dedup else size
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, size), (1, kept), (1, kept), (2, 0)]


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_columns_called_like_the_operators_own_are_ignored(spark, operator):
    rows = corpus()[:20]
    more = "doc_id long, text string, block int, n_removed int, KEPT string, segment int, key binary, t string"
    out = operator(spark.createDataFrame([(i, t, 1, 2, "x", 3, b"y", "z") for i, t in rows], more))
    assert sorted(map(str, out.collect())) == sorted(map(str, operator(frame(spark, rows)).collect()))


def test_texts_are_not_dealt(spark):
    """Joins on the number of a block leave the stored texts where they are, and no table stays behind."""
    frame = spark.range(40).selectExpr("id AS block", "cast(id AS string) AS t")
    told = spark.createDataFrame([(i, 2 * i) for i in range(0, 40, 3)], "block long, n long").repartition(3)
    stored = repeats.in_buckets(frame, "block", 4, "blocks")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("blocks")]
    with repeats.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        out = stored.join(told, "block", "left")
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {r.block: (r.t, r.n) for r in out.collect()} == {i: (str(i), None if i % 3 else 2 * i) for i in range(40)}
    docs = spark.createDataFrame([(i, "some words here " * 20) for i in range(5)], "doc_id long, text string")
    plan = repeats.repeated(docs, substrings.window_kind(35), earlier=False)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_rewritten_texts_come_from_their_blocks(spark):
    """What comes back with its repeats cut was read from blocks, with all columns; a long text comes back too, a null one null."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"a {passage} b", "x", [1]), (2, f"c {passage}", None, None), (3, None, "y", [2, 3]), (None, "", "z", []), (2, f"c {passage}", "w", [4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, rest array<int>")
    with repeats.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = substrings.drop_repeated_words(docs)
        plan = out._jdf.queryExecution().toString()
        assert "Join" not in plan and "Exchange" not in plan and out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "a b", "x", [1]), (2, "", None, None), (3, None, "y", [2, 3]), (None, "", "z", []), (2, "", "w", [4])], docs.schema).collect()))


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("block", [64, 1 << 22])
def test_texts_are_finished_where_they_are_stored(spark, monkeypatch, operator, block):
    """No Python runs after the operator's own steps, in which batches are small, whether texts come in pieces or whole."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    text = " ".join(f"w{i}" for i in range(60))
    out = operator(frame(spark, [(1, text), (2, text + " end"), (3, None), (None, "short")]))
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan and "Join" not in plan
    assert sorted((r.doc_id or -1, r.n_removed > 0) for r in out.collect()) == [(-1, False), (1, operator is substring_dedup), (2, True), (3, False)]


def test_each_segment_has_a_task_of_its_own(spark):
    """None shares a task with another, whatever their numbers hash to, and none is lost."""
    rows = spark.createDataFrame([(100 + seg, block, 1, bytes([seg])) for seg in range(16) for block in range(3)], repeats.ASKED)
    out = repeats.answered(rows, lambda own: [data + bytes([repeats.TaskContext.get().partitionId()]) for _, data in own], 16, 100)
    replies = {r.block: sorted((x.seg, bytes(x.reply)) for x in r.replies) for r in out.collect()}
    assert all([(s, d[0]) for s, d in own] == [(100 + k, k) for k in range(16)] for own in replies.values()) and len(replies) == 3
    assert len({d[1] for own in replies.values() for _, d in own}) == 16
