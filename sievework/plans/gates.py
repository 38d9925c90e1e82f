"""Contracts as gates: rows that break a rule are counted and set aside in the pass that writes the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.plans.stages import Stage

RULE = "violation"


class ContractViolated(ValueError):
    """A gate stayed shut; `counts` has the rows that each rule found."""

    def __init__(self, name: str, counts: dict[str, int]):
        super().__init__(f"{name}: " + ", ".join(f"{k} {v}" for k, v in counts.items() if v))
        self.counts = counts


@dataclass(frozen=True)
class Gate:
    """rules: what is wrong with a row where a condition holds, by name, first ones first (null: it doesn't hold).

    A row is set aside under the first rule it breaks, but counts for each. The gate shuts if a rule in `fatal` found any row, or
    more than `most` of the rows break any; what was set aside stays to be looked at.
    """

    name: str
    rules: dict[str, Column]
    fatal: frozenset[str] = field(default_factory=frozenset)
    most: float = 1.0

    def broken(self) -> list[tuple[str, Column]]:
        return [(k, F.coalesce(c, F.lit(False))) for k, c in self.rules.items()]

    def first(self) -> Column:
        return F.coalesce(*(F.when(c, k) for k, c in self.broken()), F.lit("none"))

    def counts(self) -> list[Column]:
        any_ = F.count_if(self.first() != "none").alias("any")
        return [F.count("*").alias("rows"), any_, *(F.count_if(c).alias(k) for k, c in self.broken())]

    def passed(self, rows: DataFrame, folder: str) -> tuple[DataFrame, dict[str, int]]:
        """(rows that break no rule, counts): one scan writes all rows below `folder`, dealt by the first rule each breaks, and counts them."""
        seen = Observation(self.name)
        told = rows.observe(seen, *self.counts()).withColumn(RULE, self.first())
        told.write.mode("overwrite").partitionBy(RULE).parquet(folder)
        counts = {k: int(v) for k, v in seen.get.items()}
        if any(counts[k] for k in self.fatal) or counts["any"] > self.most * counts["rows"]:
            raise ContractViolated(self.name, counts)
        kept = rows.sparkSession.read.schema(told.schema).parquet(folder)
        return kept.where(F.col(RULE) == "none").select(rows.columns), counts

    def set_aside(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(folder).where(F.col(RULE) != "none")


def gated(stage: Stage, gate: Gate, folder: str) -> Stage:
    """The stage with a gate behind it: it fails if the gate shuts, and hands on only rows that pass."""

    def run(spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        return gate.passed(stage.run(spark, done), f"{folder}/{stage.id}-checked")[0]

    checked: Callable = run
    return Stage(stage.id, checked, stage.on_failure, stage.max_attempts)
