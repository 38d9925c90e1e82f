import pytest
from pyspark.sql import functions as F

from sievework.streaming.upserts import StoredTable

SCHEMA = "key int, value string, at int, created int"


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def stored(spark, path, **more):
    return StoredTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["key"], buckets=5, **more)


def test_inserts_updates_and_replays(spark, tmp_path):
    t = stored(spark, tmp_path / "t", once=("created",))
    one = batch(spark, (1, "a", 1, 10), (2, "b", 1, 20), (1, "a2", 2, 11), (3, None, 1, 30))
    two = batch(spark, (2, "B", 5, 21), (4, "d", 5, 40), (3, "c", 5, 31))
    t.merge(one, 0, "at")
    t.merge(two, 1, "at")
    expected = [(1, "a2", 2, 11), (2, "B", 5, 20), (3, "c", 5, 30), (4, "d", 5, 40)]
    assert rows(t) == expected
    t.merge(one, 0, "at")  # the first comes again after the second
    t.merge(two, 1, "at")
    t.merge(two.limit(0), 2, "at")
    assert rows(t) == expected


def test_insert_only_if_absent(spark, tmp_path):
    t = stored(spark, tmp_path / "t", update=False)
    t.merge(batch(spark, (1, "a", 1, 1)), 0, "at")
    t.merge(batch(spark, (1, "z", 9, 9), (2, "b", 1, 1)), 1, "at")
    assert rows(t) == [(1, "a", 1, 1), (2, "b", 1, 1)]


def test_other_buckets_are_not_touched(spark, tmp_path):
    t = stored(spark, tmp_path / "t")
    t.merge(batch(spark, *((k, "x", 1, 1) for k in range(50))), 0, "at")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    t.merge(batch(spark, (7, "y", 2, 2)), 1, "at")
    left = {p for p in files if p.exists()}
    assert len({p.parent for p in files} - {p.parent for p in left}) == 1 and len(rows(t)) == 50


def test_a_stream_that_breaks_within_a_batch_ends_as_if_it_had_not(spark, tmp_path, monkeypatch):
    for n in range(3):
        batch(spark, *((k, f"v{n}", n, n) for k in range(n, 40, n + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t, whole = stored(spark, tmp_path / "t", once=("created",)), stored(spark, tmp_path / "whole", once=("created",))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole.drain(stream(), str(tmp_path / "c0"), "at")
    merge, calls = StoredTable.merge, []

    def breaks(self, frame, number, *order):
        calls.append(number)
        if calls.count(1) == 1 and number == 1:  # some buckets are in place, then the driver is gone
            merge(self, frame.where(F.pmod(F.xxhash64("key"), F.lit(5)) < 2), number, *order)
            raise RuntimeError("lost")
        merge(self, frame, number, *order)

    monkeypatch.setattr(StoredTable, "merge", breaks)
    with pytest.raises(Exception, match="lost"):
        t.drain(stream(), str(tmp_path / "c1"), "at")
    t.drain(stream(), str(tmp_path / "c1"), "at")
    assert calls == [0, 1, 1, 2] and rows(t) == rows(whole) and len(rows(t)) == 40


def test_versions_go_on_from_the_last_and_replays_change_nothing(spark, tmp_path):
    schema = "label string, hash string, at int, version long"
    make = lambda name: StoredTable(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema, ["label", "hash"], update=False, buckets=3, together=["label"])
    batch = lambda *r: spark.createDataFrame([(*x, None) for x in r], schema)
    one = batch(("a", "h1", 1), ("a", "h2", 2), ("b", "h1", 3), ("a", "h1", 4))
    two = batch(("a", "h2", 5), ("a", "h3", 6), ("c", "h9", 7), ("a", "h0", 8), ("b", "h1", 9))
    t = make("t")
    t.import_versions(one, 0, "label", "version", "at", "hash")
    t.import_versions(two, 1, "label", "version", "at", "hash")
    expected = [("a", "h0", 8, 4), ("a", "h1", 1, 1), ("a", "h2", 2, 2), ("a", "h3", 6, 3), ("b", "h1", 3, 1), ("c", "h9", 7, 1)]
    assert rows(t) == expected
    t.import_versions(two, 1, "label", "version", "at", "hash")
    assert rows(t) == expected
    broken = make("broken")  # of the second batch only some labels got in place
    broken.import_versions(one, 0, "label", "version", "at", "hash")
    broken.import_versions(two.where("label = 'a'"), 1, "label", "version", "at", "hash")
    broken.import_versions(two, 1, "label", "version", "at", "hash")
    assert rows(broken) == expected
    with pytest.raises(ValueError):
        stored(spark, tmp_path / "x").import_versions(one, 0, "label", "version", "at")
