"""Readers and sinks of the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.columns import normal_text, strict_date

#: A manual submission, as it is posted; unknown keys are refused.
SUBMISSION = "rawText string, title string, company string, location string, compensationText string, postingDate string, sourceUrl string, applicationUrl string, domain string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of submissions with a column `violation`: null for a valid row, else the first rule it breaks."""
    return validated(spark.read.text(path).withColumnRenamed("value", "payload"))


def validated(rows: DataFrame) -> DataFrame:
    """The fields of submissions (payload: JSON text), batch or stream, with `violation`; other columns are left out."""
    fields = [c.split()[0] for c in SUBMISSION.split(", ")]
    rows = rows.withColumn("s", F.from_json("payload", SUBMISSION))
    extra = F.size(F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, fields)))) > 0
    url = r"^https?://[^\s/]+"
    s = {f: F.col(f"s.{f}") for f in fields}
    violation = (
        F.when(F.json_object_keys("payload").isNull(), "not_an_object")
        .when(extra, "unknown_key")
        .when(normal_text(s["rawText"]).isNull(), "text_required")
        .when(s["postingDate"].isNotNull() & strict_date(s["postingDate"]).isNull(), "date")
        .when(~F.coalesce(s["sourceUrl"].rlike(url), F.lit(True)) | ~F.coalesce(s["applicationUrl"].rlike(url), F.lit(True)), "url")
        .when(~F.coalesce(s["domain"].rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(True)), "domain")
    )
    return rows.select(*(s[f].alias(f) for f in fields), "payload", violation.alias("violation"))


def raw_records(valid: DataFrame, discovered_at: str) -> DataFrame:
    """Raw rows that keep the payload as it came; they are written before anything is normalised."""
    return valid.select(
        F.sha2("payload", 256).alias("record_id"), "rawText", "payload", F.lit("MANUAL").alias("source_type"), F.lit(discovered_at).cast("timestamp").alias("discovered_at")
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
