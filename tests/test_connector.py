import json

from pyspark.sql import functions as F

from sievework.sources.connector import register
from sievework.sources.tables import submissions, validated

ROWS = [{"rawText": "Lead", "postingDate": "2026-02-28"}, {"rawText": " "}, {"rawText": "é x", "other": 1}, {"rawText": "x", "sourceUrl": "nope"}, {"rawText": "y", "domain": "a-b"}]


def put(folder, name, rows, end="\n"):
    (folder / name).write_text("\n".join([*(json.dumps(r, ensure_ascii=False) for r in rows), "no json"]) + end)


def told(frame):
    return sorted((r.payload, r.violation or "") for r in frame.select("payload", "violation").collect())


def test_batch_reads_what_the_text_reader_reads(spark, tmp_path):
    register(spark)
    put(tmp_path, "a.json", ROWS)
    put(tmp_path, "b.json", ROWS[:2], end="")
    (tmp_path / "_ignored").write_text("x")
    rows = spark.read.format("submissions").load(str(tmp_path))
    assert told(validated(rows)) == told(submissions(spark, str(tmp_path)))
    assert rows.where("file = 'b.json'").count() == 3 and sorted(r.line for r in rows.where("file = 'a.json'").collect()) == list(range(6))
    pruned = spark.read.format("submissions").load(str(tmp_path)).where((F.col("file") > "a.json") & F.col("payload").contains("Lead"))
    assert pruned.rdd.getNumPartitions() == 1 and pruned.count() == 1


def test_a_stream_reads_each_file_once_and_goes_on_after_a_restart(spark, tmp_path):
    register(spark)
    source = tmp_path / "in"
    source.mkdir()

    def drain():
        stream = validated(spark.readStream.format("submissions").load(str(source)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return told(spark.read.parquet(str(tmp_path / "out")))

    put(source, "1.json", ROWS)
    assert drain() == told(submissions(spark, str(source)))
    assert drain() == told(submissions(spark, str(source)))
    put(source, "2.json", ROWS[2:])
    put(source, "3.json", ROWS[:1])
    assert drain() == told(submissions(spark, str(source)))
