"""Approximate nearest neighbours by inner product with an inverted multi-index (operator 5).

Vectors are cut into two halves, each half is quantised to its own centroids, and the pair of centroids is a cell. A query
walks the cells in the order of the summed inner products of its halves with the centroids, with a heap, until the cells
hold enough vectors; these are reranked by their exact inner products. How many are enough is measured: some queries are
compared with all vectors, and the walk is as long as they need for the recall wanted. Vectors that lie in clusters need
short walks; where all directions are alike, no index spares much.

Vectors that are equal are indexed once: the smallest ids of each are all that an answer can need. Neighbouring cells make
a unit of about UNIT_ROWS vectors, a cell with more is cut into several; a query goes once to each unit that it has cells
in, with the list of them, and a unit that very many queries reach is copied. So no task gathers a hot cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialise

SAMPLE, SAMPLE_VALUES, ROUNDS = 20_000, 1 << 22, 12  # vectors, and numbers in them, that centroids are fitted on at most
CENTROIDS = 4, 1024  # a half; in between as the root of the number of vectors
RECALL, MEASURED = 0.95, 64  # the recall wanted, and how many queries measure what it takes
CHUNK = 16  # neighbouring columns that the walk takes at a time
UNIT_ROWS, UNITS, TOGETHER = 4096, 1 << 16, 64


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v array<double>): rows with an id and a vector of the usual length that is not zero, null or non-finite anywhere."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual.n if usual else -1))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, v, ids): each vector once, with its `keep` smallest ids (ranked before the shuffle, so no copy is gathered)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(1).flatten().to_numpy() + 0.0, batch.num_rows  # + 0.0: minus zero is zero
            v = flat.reshape(size, -1) if size else flat.reshape(0, 1)
            h = np.array([xxhash.xxh3_128_digest(r.tobytes()) for r in v] or np.zeros((0, 16), np.uint8)).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(1)], ["id", "h1", "h2", "v"])

    rows = rows.mapInArrow(hashed, "id long, h1 long, h2 long, v array<double>")
    nth = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))  # a repeated row counts once
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def near_cells(query: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Non-empty cells by falling sum of the halves' inner products, CHUNK pairs at a time, until they hold `wanted` vectors."""
    half = left.shape[1]
    a, b = left @ query[:half], right @ query[half:]
    i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    first, step = a[i_of].tolist(), b[j_of[::CHUNK]].tolist()
    columns = [j_of[k : k + CHUNK] for k in range(0, len(j_of), CHUNK)]
    heap, out, count = [(-(first[0] + step[0]), 0, 0)], [], 0
    # of each row the next chunk is entered when one is popped, and with a row's first chunk the next row
    while heap and count < wanted:
        _, i, k = heapq.heappop(heap)
        cells = i_of[i] * len(b) + columns[k]
        held = sizes[cells]
        out.append(cells[held > 0])
        count += int(held.sum())
        if k + 1 < len(columns):
            heapq.heappush(heap, (-(first[i] + step[k + 1]), i, k + 1))
        if k == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + step[0]), i + 1, 0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def top(query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best scores, and of all that tie with the last of them."""
    order = np.lexsort((-score, query))
    q, s = query[order], score[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    size = np.diff(np.append(begin, len(q)))
    last = np.repeat(s[begin + np.minimum(size, k) - 1], size)
    return order[s >= last]


def walk_length(asked: DataFrame, placed: DataFrame, k: int, recall: float, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> int:
    """How many vectors a walk must pass so that some queries (about MEASURED) find this share of their k nearest; all for a recall of 1."""
    count = int(sizes.sum())
    if recall >= 1:
        return count
    drawn = F.pmod("h2", F.lit(1_000_000)) < int(1_000_000 * min(1.0, MEASURED / max(1, asked.count())))
    some = asked.where(drawn).select("v").limit(2 * MEASURED).toArrow()
    if not some.num_rows:
        return count
    queries = some.column(0).combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)
    shared = placed.sparkSession.sparkContext.broadcast(queries)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value @ batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).T
                at = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                own = np.repeat(np.arange(len(score)), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(score[own, at.ravel()]), batch.column(1).take(pa.array(at.ravel()))], ["q", "score", "cell"])

    found = placed.select("v", "cell").mapInArrow(best, "q int, score double, cell long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
    nearest = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("q", "cell").collect()  # at most 2 * MEASURED * (k + 1) rows
    needed = []
    by_query: dict[int, list[int]] = {}
    for r in nearest:
        by_query.setdefault(r.q, []).append(r.cell)
    for q, cells in by_query.items():
        order = near_cells(queries[q], left, right, sizes, count)
        place = np.empty(len(sizes), np.int64)
        place[order] = np.arange(len(order))
        needed += np.cumsum(sizes[order])[place[cells]].tolist()
    return int(np.quantile(needed, recall, method="higher"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product found for each id divisible by `every`.

    Candidates are all other rows; ties go to the smaller vec_id; scores are exact, in double precision. Rows whose vector is
    null, zero, has a null or non-finite component or another length than most take no part. Equal vectors under several ids
    are all found. A repeated vec_id with equal vectors counts once. No usable rows, or a single one, give no rows. recall is
    the share of the nearest that is aimed at; 1 compares each query with all.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    index = materialise(distinct(rows, k + 1), "vectors")
    count = index.count()
    one = index.select(F.size("v").alias("n")).first()
    if not one:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(1, min(SAMPLE, SAMPLE_VALUES // one.n))
    chosen = index.where(F.pmod("h1", F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / count))).select("v").limit(2 * most).toArrow()
    chosen = chosen if chosen.num_rows else index.select("v").limit(1).toArrow()
    sample = chosen.column(0).combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, -1)
    sample = sample[np.lexsort(sample.T[::-1])]
    half = max(1, sample.shape[1] // 2)
    cells = int(min(CENTROIDS[1], max(CENTROIDS[0], 1 << round(np.log2(max(1, count) ** 0.5)))))
    left, right = k_means(sample[:, :half], cells, 1), k_means(sample[:, half:], cells, 2)
    shared = spark.sparkContext.broadcast((left, right))  # at most 2 x CENTROIDS[1] half vectors
    across = len(right)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = shared.value
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(2))
                near = [(x @ c.T - 0.5 * (c**2).sum(1)).argmax(1) for x, c in ((v[:, :half], left), (v[:, half:], right))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[0] * across + near[1])], ["h1", "h2", "v", "cell"])

    placed = materialise(index.select("h1", "h2", "v").mapInArrow(assign, "h1 long, h2 long, v array<double>, cell long"), "placed")
    sizes = np.zeros(len(left) * across, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most CENTROIDS[1] squared
        sizes[r["cell"]] = r["count"]
    asked = materialise(distinct(rows.where(F.col("id") % every == 0), 1).select("h1", "h2", "v"), "queries")
    wanted = walk_length(asked, placed, k, recall, left, right, sizes)
    unit_rows = max(unit_rows, -(-count // UNITS))
    pieces = np.maximum(1, -(-sizes // unit_rows))
    big = pieces > 1
    unit_of = np.cumsum(np.where(big, 0, sizes)) // unit_rows
    unit_of[big] = unit_of.max(initial=0) + 1 + np.cumsum(pieces[big]) - pieces[big]
    directory = spark.sparkContext.broadcast((sizes, unit_of, pieces))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = shared.value
        sizes, unit_of, pieces = directory.value
        for batch in batches:
            owner, units, lists = [], [], []
            for k, q in enumerate(matrix(batch.column(2)) if batch.num_rows else []):
                cells = np.sort(near_cells(q, left, right, sizes, wanted))
                cells = np.repeat(cells, pieces[cells])
                nth = np.arange(len(cells)) - np.searchsorted(cells, cells)
                unit = unit_of[cells] + nth
                order = np.argsort(unit, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
                    owner.append(k)
                    units.append(int(unit[own[0]]))
                    lists.append(cells[own].astype(np.int32))
                if len(owner) > 2000 or k == batch.num_rows - 1:
                    take = pa.array(owner)
                    offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(units, pa.int64()), values], ["h1", "h2", "v", "unit", "cells"])
                    owner, units, lists = [], [], []

    asked = asked.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() // 4096))  # the walk is the work, not the reading
    probes = materialise(asked.mapInArrow(walk, "h1 long, h2 long, v array<double>, unit long, cells array<int>"), "probes")
    demand = np.ones(int((unit_of + pieces).max()), np.int64)
    for r in probes.groupBy("unit").count().collect():  # about UNITS rows at most, and one more a large cell
        demand[r["unit"]] = r["count"]
    copies = spark.sparkContext.broadcast(-(-demand // (4 * unit_rows)))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector in its unit, once for each copy of the unit."""
        _, unit_of, pieces = directory.value
        for batch in batches:
            cell, h = batch.column(3).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            unit = unit_of[cell] + (h % pieces[cell].astype(np.uint64)).astype(np.int64)
            times = copies.value[unit]
            owner = np.repeat(np.arange(len(cell)), times)
            copy = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32)), pa.array(cell[owner].astype(np.int32)))
            columns = [pa.array(unit[owner]), pa.array(copy), pa.array(np.zeros(len(owner), np.int32)), *(batch.column(k).take(pa.array(owner)) for k in range(3)), own]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "copy", "query", "h1", "h2", "v", "cells"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query at one copy of each of its units."""
        for batch in batches:
            unit, h = batch.column(3).to_numpy(), batch.column(0).to_numpy().view(np.uint64)
            copy = (h % copies.value[unit].astype(np.uint64)).astype(np.int64)
            columns = [batch.column(3), pa.array(copy), pa.array(np.ones(len(unit), np.int32)), *(batch.column(k) for k in (0, 1, 2, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "copy", "query", "h1", "h2", "v", "cells"])

    schema_both = "unit long, copy long, query int, h1 long, h2 long, v array<double>, cells array<int>"
    both = placed.mapInArrow(stored, schema_both).unionByName(probes.mapInArrow(asking, schema_both))
    both = both.repartition("unit", "copy").sortWithinPartitions("unit", "copy", "query")
    found_schema = "q1 long, q2 long, h1 long, h2 long, score double"

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, base, out, size = None, [], None, [], 0

        def best() -> tuple[np.ndarray, np.ndarray]:
            ids = np.concatenate([o[0] for o in out])
            score = np.concatenate([o[1] for o in out])
            _, query = np.unique(ids[:, :2], axis=0, return_inverse=True)
            at = top(query.ravel(), score, k + 1)
            return ids[at], score[at]

        for batch in batches:
            unit = np.stack([batch.column(i).to_numpy() for i in range(2)], 1)
            query = batch.column(2).to_numpy()
            cut = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(1) | (query[1:] != query[:-1])))
            ids = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()], 1)
            v = matrix(batch.column(5))
            for a, b in zip(cut, np.append(cut[1:], len(unit))):
                if tuple(unit[a]) != now:
                    now, held, base = tuple(unit[a]), [], None
                if not query[a]:
                    held.append((ids[a:b], v[a:b], batch.column(6)[a:b].flatten().to_numpy()))
                    continue
                if not held:
                    continue
                if base is None:
                    base = [np.concatenate([h[i] for h in held]) for i in range(3)]
                    order = np.argsort(base[2], kind="stable")
                    base = [x[order] for x in base]
                for begin in range(a, b, TOGETHER):
                    at = np.arange(begin, min(b, begin + TOGETHER))
                    near = v[at] @ base[1].T
                    for row, n in enumerate(at.tolist()):
                        own = batch.column(6)[n].values.to_numpy()
                        place = np.minimum(np.searchsorted(own, base[2]), len(own) - 1)
                        inside = np.flatnonzero(own[place] == base[2])
                        rough = near[row, inside]
                        if len(rough) > k + 1:  # the order of sums may differ by rounding, so a little more is kept and summed anew
                            least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                            inside = inside[rough >= least - 1e-9 * max(1.0, abs(least))]
                        score = (base[1][inside] * v[n]).sum(axis=1)
                        keep = top(np.zeros(len(score), np.int64), score, k + 1)
                        out.append((np.concatenate([np.repeat(ids[n : n + 1], len(keep), 0), base[0][inside[keep]]], 1), score[keep]))
                        size += len(keep)
            if size > 1_000_000:
                out = [best()]
                size = len(out[0][1])
                if size > 500_000:
                    yield emit(*out[0])
                    out, size = [], 0
        if out:
            yield emit(*best())

    def emit(ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(ids[:, k]) for k in range(4)), pa.array(score)], ["q1", "q2", "h1", "h2", "score"])

    found = both.mapInArrow(rerank, found_schema)
    named = found.join(index.select("h1", "h2", "ids"), ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    few = materialise(named.withColumn("nth", nth).where(F.col("nth") <= k + 1), "found")
    asking = distinct_ids(rows.where(F.col("id") % every == 0)).distinct()
    out = asking.join(few, (asking.h1 == few.q1) & (asking.h2 == few.q2)).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def distinct_ids(rows: DataFrame) -> DataFrame:
    """(query_id, h1, h2) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0
                h = np.array([xxhash.xxh3_128_digest(r.tobytes()) for r in v]).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[:, 0]), pa.array(h[:, 1])], ["query_id", "h1", "h2"])

    return rows.mapInArrow(hashed, "query_id long, h1 long, h2 long")
