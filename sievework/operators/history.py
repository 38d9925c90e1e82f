"""Latest and first rows of a key, versions, queues and set operations that keep an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.ordinals import ordinals

def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key; Spark plans the rank as a group limit before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def flagged_latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("is_latest", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def versions(arrivals: DataFrame) -> DataFrame:
    """(label, content_hash, first_arrival, version): content that comes again keeps its version."""
    first = arrivals.groupBy("label", "content_hash").agg(F.min("arrival").alias("first_arrival"), F.count("*").alias("imports"))
    return ordinals(first, ["label"], ["first_arrival", "content_hash"], "version")


def next_versions(versioned: DataFrame) -> DataFrame:
    return versioned.groupBy("label").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key isn't there yet."""
    return new.join(old.select(keys), keys, "left_anti")


def last_wins(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """The first position with the last value of each key."""
    return rows.groupBy(key).agg(F.min(pos).alias("pos"), F.max_by(value, pos).alias("value"))


def ordered_union(groups: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """The distinct values of each key in the order they first come."""
    first = groups.groupBy(key, value).agg(F.min(pos).alias("pos_"))  # so that a key's repeated values are never gathered
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos_", F.col(value)))), lambda x: x[value])
    return first.groupBy(key).agg(F.array_join(items, ",").alias("items"), F.count("*").cast("int").alias("n_items"))


CLAIMABLE = "attempt < max_attempts and ((status = 'PENDING' and available_at <= now) or (status = 'RUNNING' and lease_expires_at < now))"


def claimed(tasks: DataFrame, lease_seconds: int) -> DataFrame:
    """What a claim would make of each task: RUNNING, an attempt more and a lease, where it can be claimed."""
    can = F.coalesce(F.expr(CLAIMABLE), F.lit(False))
    return tasks.select(
        "task_id",
        can.alias("claimable"),
        F.when(can, "RUNNING").otherwise(F.col("status")).alias("status_after"),
        (F.col("attempt") + can.cast("int")).alias("attempt_after"),
        F.when(can, F.col("now") + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")).alias("lease_after"),
    )


def queue_head(tasks: DataFrame) -> DataFrame:
    """The oldest claimable task."""
    return tasks.where(CLAIMABLE).orderBy("created_at", "task_id").limit(1)


def claim_batches(tasks: DataFrame, workers: int, each: int) -> DataFrame:
    """(task_id, worker, nth): up to `each` claimable tasks for each worker, numbered from 0, the oldest first and dealt in turn.

    No task goes to two workers, as each has one rank among all; the ranks are counted range by range.
    """
    ranked = ordinals(tasks.where(CLAIMABLE).select("task_id", "created_at"), [], ["created_at", "task_id"], "rank").where(F.col("rank") <= workers * each)
    rank = F.col("rank") - 1
    return ranked.select("task_id", (rank % workers).cast("int").alias("worker"), F.floor(rank / workers).cast("int").alias("nth"))


def finished(tasks: DataFrame) -> DataFrame:
    """After an outcome: COMPLETED, PENDING again while it may be retried and attempts are left, else FAILED."""
    again = F.col("retryable") & (F.col("attempt") < F.col("max_attempts"))
    after = F.when(F.col("succeeded"), "COMPLETED").when(again, "PENDING").otherwise("FAILED")
    return tasks.select("task_id", after.alias("status_after"))


def worked(tasks: DataFrame, outcomes: DataFrame, lease_seconds: int) -> DataFrame:
    """One step of a worker over a batch of tasks: those that can be claimed are, and end by their outcome.

    outcomes (task_id, succeeded, retryable) of what was processed; a claimed task without one keeps its lease, and an outcome
    whose kind isn't known may not be tried again. The result is a whole task table for a single writer to put in place.
    """
    can = F.coalesce(F.expr(CLAIMABLE), F.lit(False))
    taken = tasks.withColumns({"claimed_": can, "attempt": F.col("attempt") + can.cast("int")}).join(outcomes, "task_id", "left")
    again = F.coalesce("retryable", F.lit(False)) & (F.col("attempt") < F.col("max_attempts"))
    ended = F.when(F.col("succeeded").isNull(), "RUNNING").when(F.col("succeeded"), "COMPLETED").when(again, "PENDING").otherwise("FAILED")
    status = F.when(F.col("claimed_"), ended).otherwise(F.col("status"))
    lease = F.when(status == "RUNNING", F.when(F.col("claimed_"), F.col("now") + F.make_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_expires_at")))
    return taken.select("task_id", status.alias("status"), "attempt", lease.alias("lease_expires_at"))


def call_outcomes(attempts: DataFrame, limit: int) -> DataFrame:
    """(call_id, attempts, code, retryable) of calls: the first attempt that succeeds or may not be repeated ends a call, limit + 1 at most are made.

    attempts (call_id, nth, status, http): status is SUCCESS, TIMEOUT, PROVIDER_FAILURE or VALIDATION_FAILURE. Output that
    stays invalid has used up its repeats, so the stage may not repeat the call either.
    """
    invalid, timeout = F.col("status") == "VALIDATION_FAILURE", F.col("status") == "TIMEOUT"
    again = invalid | timeout | ((F.col("status") == "PROVIDER_FAILURE") & F.coalesce(F.col("http").isin(408, 429) | (F.col("http") >= 500), F.lit(False)))
    code = F.when(invalid, "STRUCTURED_OUTPUT_INVALID").when(timeout, "PROVIDER_TIMEOUT").when(F.col("status") == "PROVIDER_FAILURE", "PROVIDER_REQUEST_FAILED")
    made = attempts.where(F.col("nth") <= limit + 1).withColumns({"again": again, "code": code})
    ends = made.groupBy("call_id").agg(F.min(F.when(~F.col("again"), F.col("nth"))).alias("final"), F.max("nth").alias("most"), F.max_by(F.struct("code", "again"), "nth").alias("last"), F.min_by(F.when(~F.col("again"), F.col("code")), F.when(~F.col("again"), F.col("nth"))).alias("end_code"))
    over = F.col("final").isNotNull()
    open_ = ~over & (F.col("most") < limit + 1)
    return ends.select(
        "call_id", F.coalesce("final", "most").alias("attempts"), F.when(over, F.col("end_code")).otherwise(F.col("last.code")).alias("code"),
        F.when(over, F.lit(False)).when(open_, F.lit(True)).otherwise(F.col("last.code") != "STRUCTURED_OUTPUT_INVALID").alias("retryable"),
    )


def retry_class(http: Column, timeout: Column) -> Column:
    """Timeouts, 408, 429 and server errors may be tried again."""
    return F.when(timeout | http.isin(408, 429) | (http >= 500), "RETRYABLE").when(http < 400, "OK").otherwise("FATAL")
