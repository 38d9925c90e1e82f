"""What each stage of an evaluation sees of those before it, stored once: a chain of pointers instead of lists.

A row a stage holds what the stage itself adds and where the last stage that added anything is; so the table grows with the
stages, not with their square, and the list that a stage sees is put together only for the stages that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chained(stages: DataFrame) -> DataFrame:
    """stages (evaluation_id, position, stage_id, completed) -> (evaluation_id, position, parent, delta, nth).

    delta is the stage's own id where it is completed, else null; parent the position of the last completed stage before it, null
    for none; nth how many completed stages come before it. Positions of an evaluation differ.
    """
    before = Window.partitionBy("evaluation_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.when(F.col("completed"), F.col("stage_id"))
    last = F.max(F.when(F.col("completed"), F.col("position"))).over(before)
    return stages.select("evaluation_id", "position", last.alias("parent"), delta.alias("delta"), F.count(delta).over(before).alias("nth"))


def expanded(chain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(evaluation_id, position, context) for the wanted stages (evaluation_id, position): the deltas before each, in order.

    A wanted stage is joined with its evaluation's deltas, so what is made is as long as the lists that come out.
    """
    deltas = chain.where("delta is not null").select("evaluation_id", F.col("position").alias("at"), "delta")
    asked = wanted.join(chain.select("evaluation_id", "position"), ["evaluation_id", "position"], "left_semi")
    found = asked.join(deltas, "evaluation_id").where("at < position")
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", "delta"))), lambda x: x["delta"])
    lists = found.groupBy("evaluation_id", "position").agg(F.array_join(items, ">").alias("context"))
    return asked.join(lists, ["evaluation_id", "position"], "left").select("evaluation_id", "position", F.coalesce("context", F.lit("")).alias("context"))
