"""Sharding by vector bin packing (operator 12).

Documents of equal text are a group, a vector of bytes, tokens and rows. Groups are placed by falling size, each where the
dot product with what the shard has left is highest; what is left may be below nothing, so this is the choice that keeps
the squares of all that is left smallest, in the three measures jointly. Groups that hold more than a grain (a 64th of a
shard) of anything are few whatever the input, as many at most as there are grains of the three measures, and are placed
first, by the driver. All others are dealt to cells of some thousand by their hash, and each cell is packed in a task of
its own against its part of what the first step left in each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WORD, materialise, utf8
from sievework.operators.ordinals import ordinals

SHARDS, GRAINS, CELL_GROUPS, OVERHEAD = 40, 64, 4096, 16
MEASURES = ["bytes", "tokens", "rows"]
#: Bytes count double, as it is they that must be even; so many times placements are gone over again.
WEIGHTS, AGAIN = np.array([2.0, 1.0, 1.0]), 2


def pack(items: np.ndarray, room: np.ndarray, again: int = AGAIN) -> np.ndarray:
    """The shard of each item (items x measures), in falling order of size, given what room each shard has (shards x measures).

    Measures are made comparable by the room there is, and weighed; equal scores go to the first shard. `again` times each item
    is taken out and placed anew, now that the others are known: that never makes the squares of what is left greater.
    """
    scale = np.maximum(room.sum(0) / len(room), 1e-9) / WEIGHTS
    items, left = items / scale, room / scale
    order = np.argsort(-(items / WEIGHTS).max(1), kind="stable")
    out = np.full(len(items), -1, np.int32)
    for k in np.tile(order, 1 + again):
        if out[k] >= 0:
            left[out[k]] += items[k]
        best = out[k] = np.argmax(left @ items[k])
        left[best] -= items[k]
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot) of every document, and a struct `row` of the columns to carry.

    Shards, from 0, hold nearly equal bytes, and nearly equal tokens and rows as far as the texts allow. size is the text's UTF-8
    bytes and OVERHEAD, tokens its words. Documents of equal text share a shard, unless together they are more than a shard's
    even part of the bytes, tokens or rows: then they are dealt by a hash of doc_id to portions of about a grain, which are
    placed like groups. slot numbers a shard's documents from 0 without gaps, in order of doc_id (null first). A null text counts
    as an empty one; a null doc_id is an id, rows that agree in doc_id and text stay together. One text of any length is never cut.
    Reruns agree, whatever the partitions. Other columns, whatever their names, are ignored unless carried; an empty table gives
    no rows.
    """
    text = F.coalesce(utf8("text"), F.lit(b""))
    row = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = materialise(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), row.alias("row"),
        ), "sizes",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = materialise(rows.groupBy("key").agg(*sums), "groups")
    total = groups.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES), F.count("*").alias("groups")).first()
    grain = {m: total[m] / (shards * GRAINS) for m in MEASURES}
    share = F.greatest(*(F.col(m) / max(grain[m], 1e-9) for m in MEASURES))
    large = groups.where(share > 1).withColumn("portions", F.when(share > GRAINS, F.ceil(share)).otherwise(1))
    kept = {r.key: r for r in large.collect()}  # 3 x shards x GRAINS at most, as each has over a grain of something

    portions = docs.sparkSession.createDataFrame([(r.key, r.portions) for r in kept.values()], "key long, portions long")
    rows = rows.join(F.broadcast(portions), "key", "left").withColumn("portion", F.pmod(F.xxhash64("doc_id"), "portions"))
    cut = rows.where("portions > 1").groupBy("key", "portion").agg(*sums).collect()  # a grain each, so no more than those
    items = sorted([(r.key, r.portion, *(r[m] for m in MEASURES)) for r in cut] + [(r.key, 0, *(r[m] for m in MEASURES)) for r in kept.values() if r.portions == 1])
    vectors = np.array([i[2:] for i in items], float).reshape(-1, 3)
    room = np.tile([total[m] / shards for m in MEASURES], (shards, 1))
    chosen = pack(vectors, room)
    np.subtract.at(room, chosen, vectors)
    room = np.maximum(room, 0)
    room /= np.maximum(room.sum(0), 1e-9)

    cells = max(1, -(-total["groups"] // CELL_GROUPS))

    def place(table: pa.Table) -> pa.Table:
        """One cell; its shards come in an order of its own, so that no shard is first everywhere."""
        table = table.sort_by("key")
        vectors = np.column_stack([table.column(m).to_numpy() for m in MEASURES]).astype(float)
        order = np.random.default_rng(int(table.column("cell")[0].as_py())).permutation(shards)
        found = order[pack(vectors, room[order] * vectors.sum(0))]
        return pa.table({"key": table.column("key"), "shard": pa.array(found, pa.int32())})

    small = groups.where(share <= 1).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    placed = small.groupBy("cell").applyInArrow(place, "key long, shard int")
    fixed = docs.sparkSession.createDataFrame([(*i[:2], int(s)) for i, s in zip(items, chosen)], "key long, portion long, shard int")
    columns = ["doc_id", "size", "tokens", "text_crc32", "key", "row", "shard"]
    first = rows.where("portions is not null").join(F.broadcast(fixed), ["key", "portion"]).select(columns)
    rest = rows.where("portions is null").drop("portions", "portion").join(placed, "key").select(columns)
    out = ordinals(first.unionByName(rest), ["shard"], ["doc_id", "key"], "slot").withColumn("slot", F.col("slot") - 1)
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", "slot", *(["row"] if carry else []))


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder a shard with its documents in the order of their slots, some files each; placed: shard_documents() with carried columns."""
    dealt = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
