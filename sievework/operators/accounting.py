"""Usage and cost of attempts; unknown stays unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.columns import operation_cost, strict_sum, token_count


def priced(attempts: DataFrame, prices: DataFrame) -> DataFrame:
    """attempts (tokens_in, cached, out, model, version) with `cost` and `currency` by an exact match of model and version.

    prices is a dimension of a few rows. An attempt without a price has no cost.
    """
    joined = attempts.join(F.broadcast(prices), ["model", "version"], "left")
    price = {k: F.col(f"price_{k}") for k in ("input", "cached", "output")} | {k: F.col(k) for k in ("threshold", "input_factor", "output_factor")}
    return joined.withColumn("cost", operation_cost(F.col("tokens_in"), F.col("cached"), F.col("out"), price))


def price_problems(needed: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, version, problem): prices that are missing or given twice."""
    keys = ["model", "version"]
    twice = prices.groupBy(keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    return needed.select(keys).distinct().join(prices, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(twice)


def attempts_of_events(events: DataFrame) -> DataFrame:
    """Events as an attempt log: `k` of the properties are the tokens sent in, the value's whole part those got out."""
    sent = token_count(F.get_json_object("props", "$.k"))
    return events.select(
        "event_id", "ts", F.col("user_id").alias("evaluation_id"), F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("version"),
        sent.alias("tokens_in"), F.when(sent % 16 != 0, F.floor(sent / 4)).alias("cached"), F.floor("value").alias("out"),
        F.floor(F.col("value") / 3).alias("reasoning"), (sent + F.floor("value")).alias("total"),
    )


def usage_summary(attempts: DataFrame) -> DataFrame:
    """A row an evaluation: strict sums, a cost only in one currency, and versions in the order they were first seen.

    Attempts are summed up a version first, so that an evaluation's attempts are never gathered; a sum is known only if every
    part of it is.
    """
    counts = ["tokens_in", "cached", "out", "reasoning", "total"]
    sums = [(c, strict_sum(F.col(c))) for c in [*counts, "cost"]]
    parts = attempts.groupBy("evaluation_id", "version").agg(
        F.count("*").alias("attempts"), *(s.alias(c) for c, s in sums), F.min(F.struct("ts", "event_id")).alias("seen"), F.min("currency").alias("least"), F.max("currency").alias("most"),
    )
    one = F.min("least") == F.max("most")
    versions = F.transform(F.array_sort(F.collect_list(F.struct("seen", "version"))), lambda x: x["version"])
    return parts.groupBy("evaluation_id").agg(
        F.sum("attempts").alias("attempts"),
        *(s.alias({"out": "tokens_out"}.get(c, c)) for c, s in sums[:-1]),
        F.when(one, strict_sum(F.col("cost"))).cast("double").alias("cost"),
        F.when(one & strict_sum(F.col("cost")).isNotNull(), F.min("least")).alias("currency"),
        F.array_join(versions, ",").alias("versions"),
    )


def with_ordinals(attempts: DataFrame, budget: int) -> DataFrame:
    """Each call's number within (evaluation, model), and whether the evaluation's budget still allowed it."""
    order = [F.col("ts"), F.col("event_id")]
    nth = F.row_number().over(Window.partitionBy("evaluation_id", "model").orderBy(*order))
    before = F.count("*").over(Window.partitionBy("evaluation_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return attempts.select("event_id", "evaluation_id", nth.alias("attempt"), before.alias("calls_before"), (before < budget).alias("allowed"))


def next_attempt(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("evaluation_id", "model").agg((F.count("*") + 1).alias("next_attempt"))
