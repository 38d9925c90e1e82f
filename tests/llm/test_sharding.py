import zlib

import numpy as np
import pytest

from sievework.llm.sharding import pack, shard_documents, write_shards


@pytest.mark.parametrize("again", [0, 1])
def test_pack_places_where_the_dot_product_is_highest(again):
    rng = np.random.default_rng(3)
    items, room = rng.integers(1, 100, (60, 3)).astype(float), np.tile([800.0, 750.0, 900.0], (4, 1))
    scaled, weighed = (items / room.mean(0)).tolist(), (items / room.mean(0) * [2, 1, 1]).tolist()
    left, expected = [[2.0, 1.0, 1.0] for _ in range(4)], {}
    order = sorted(range(60), key=lambda k: -max(scaled[k]))
    for k in order * (1 + again):
        v = weighed[k]
        if k in expected:
            left[expected[k]] = [a + b for a, b in zip(left[expected[k]], v)]
        scores = [sum(a * b for a, b in zip(r, v)) for r in left]
        best = expected[k] = max(range(4), key=lambda s: scores[s])
        left[best] = [a - b for a, b in zip(left[best], v)]
    assert pack(items, room, again).tolist() == [expected[k] for k in range(60)]


def corpus(n=6000):
    """A third of all rows is one text, one is very long, groups of a few to hundreds, short and long texts."""
    rng = np.random.default_rng(7)
    for i in range(n):
        if i % 3 == 0:
            yield i, "the same notice again and again"
        elif i == 1:
            yield i, "very " * 20_000
        elif i % 50 == 1:
            yield i, f"group {i % 7} " * 30
        else:
            yield i, f"text {i} " + ("longword" * 9 + " ") * int(rng.integers(1, 30)) if i % 2 else f"text {i} " + "a b " * int(rng.integers(1, 200))


@pytest.fixture(scope="module")
def placed(spark):
    rows = list(corpus())
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, KEY string")
    return dict(rows), shard_documents(docs.repartition(6), 8).collect(), docs


def test_every_document_once_with_its_measures(placed):
    texts, out, _ = placed
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.tokens, r.text_crc32) == (len(raw) + 16, len(raw.split()), zlib.crc32(raw))


def test_shards_are_even_in_bytes_tokens_and_rows(placed):
    _, out, _ = placed
    sums = np.zeros((8, 3))
    for r in out:
        sums[r.shard] += (r.size, r.tokens, 1)
    off = np.abs(sums / sums.mean(0) - 1).max(0)
    assert off[0] < 0.01 and (off[1:] < 0.03).all(), off


def test_equal_texts_share_a_shard_unless_they_outgrow_it(placed):
    texts, out, _ = placed
    shards = {}
    for r in out:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert {t for t, s in shards.items() if len(s) > 1} == {"the same notice again and again"}


def test_slots_have_no_gaps_and_follow_the_ids(placed):
    _, out, _ = placed
    for s in range(8):
        own = sorted((r.slot, r.doc_id) for r in out if r.shard == s)
        assert [k for k, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_reruns_agree(placed):
    _, out, docs = placed
    again = shard_documents(docs.repartition(3, "text"), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (5, None), (None, None)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id int, text string"), 3).collect()
    assert len(out) == 8 and {(r.size, r.tokens, r.text_crc32) for r in out} == {(16, 0, 0), (19, 2, zlib.crc32(b"a b"))}
    assert sorted((r.shard, r.slot) for r in out) == sorted((s, k) for s in range(3) for k in range(sum(r.shard == s for r in out)))
    assert shard_documents(spark.createDataFrame([], "doc_id int, text string"), 3).collect() == []


def test_written_shards_hold_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(200)], "doc_id long, text string, shard string")
    placed = shard_documents(docs, 4, carry=("doc_id", "text"))
    write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, f"text {i}") for i in range(200)}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}
