"""Mixing sources to target weights by capped water-filling (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.llm.common import WORD, materialise

GROUP_ROWS, SEED = 256, 7


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """(source, source_size, weight) -> with target: weights share `share` x all sizes, no source above epochs x its size.

    Handing the excess of full sources to the others by weight, until none is above its cap, ends at
    target = min(cap, level x weight) with one level for all. The level follows from the caps per weight in order: it lies
    where the caps below it and the weights above it add up to what is to be shared. One row a source is all this sees.
    """
    every = Window.orderBy("full", "source")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("cap", epochs * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    total = sources.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("weights", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("own_level", (share * F.col("all_size") - F.col("caps")) / F.col("weights"))
    # past the first source that isn't full the levels only fall
    level = rows.agg(F.max(F.when(F.col("own_level") <= F.col("full"), F.col("own_level"))).alias("level"))
    rows = rows.crossJoin(F.broadcast(level))  # one row
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every document, and a struct `row` of the columns to carry.

    Sources in order of code points, null last, weigh `weights`, repeating. A document is taken floor(target / source_size)
    whole times, and once more if its draw for the rest falls to it. Draws are made in groups of about `GROUP_ROWS`
    documents of one source, chosen by a seeded hash: in each, documents go by falling size, and one is taken when what is
    owed so far reaches a seeded part of its size, so that a group misses its share by little more than its smallest
    document. Reruns, whatever the partitions, agree. Null texts have size 0; a null source is a source; a source of size 0
    has target 0; rows with equal ids are told apart by their text, and if that agrees too by nothing that matters.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    row = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = materialise(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), row.alias("row")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), nth + 1).alias("weight"))
    groups = sources.select(F.col("source").alias("s"), F.ceil(F.col("rows") / GROUP_ROWS).alias("groups"))
    filled = water_fill(weighed.where("source_size > 0"), share, epochs)
    plan = materialise(
        filled.unionByName(weighed.where("source_size = 0").withColumn("target", F.lit(0.0)))
        .join(groups, F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), "source_size", "target", "groups"),
        "targets",
    )
    names = ["doc_id", "source", "size", "source_size", "target", "row", "times", "taken"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by source, group, falling size and draw; a group may reach over several batches."""
        now, owed = None, 0.0
        for batch in batches:
            source, group, size, draw, total, target = (batch.column(k).to_pylist() for k in (1, 7, 2, 6, 3, 4))
            times = []
            for s, g, n, r, all_size, aim in zip(source, group, size, draw, total, target):
                if (s, g) != now:
                    now, owed = (s, g), 0.0
                rate = aim / all_size if all_size else 0.0
                whole = int(rate)
                owed += (rate - whole) * n
                once = n > 0 and rate > whole and owed >= n * (0.25 + 0.5 * ((r & 0xFFFFFF) / 0x1000000))
                owed -= n if once else 0
                times.append(whole + once)
            times = pa.array(times, pa.int64())
            taken = pa.array(times.to_numpy() * np.array(size, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), times, taken], names)

    dealt = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))) if plan.count() <= 100_000 else rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    dealt = dealt.select(*names[:6], "draw", F.pmod(F.xxhash64("draw"), F.col("groups")).alias("group"))
    dealt = dealt.repartition("source", "group").sortWithinPartitions("source", "group", F.desc("size"), "draw", "doc_id")
    schema = StructType([*dealt.select(*names[:6]).schema, StructField("times", LongType()), StructField("taken", LongType())])
    out = dealt.mapInArrow(take, schema)
    return out if carry else out.drop("row")
