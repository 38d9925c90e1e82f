"""Hard negatives from vantage-point trees over norm-augmented vectors (operator 13).

A coordinate sqrt(M^2 - |x|^2), M the largest norm, makes all rows equally long, and a query gets 0 there: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so that higher scores are smaller distances and a window of scores is an annulus around the
anchor. Rows are dealt by hash to blocks of some thousand, each with a tree of its own; anchors are searched in blocks too. A
task takes one block of anchors through a lane, one block of rows after another, and keeps the best k of each request; lanes
are merged by a window, at most k rows each. In a tree, leaves are entered nearest first from the inner edge of the annulus,
and a request is done when no leaf left can hold a row as near as its k-th. Scores are whole numbers and exact; bounds
from distances have slack for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialise

LEVELS, POSITIVES, NEGATIVES, LOW, HIGH, EVERY = 256, 5, 10, 30, 90, 100
BLOCK_ROWS, ANCHOR_ROWS, LEAF_ROWS = 4096, 1024, 128
TASKS = 1024  # about as many are made of few anchor blocks by more lanes
FAR = 1 << 62


class Tree:
    """Rows halved again and again by their distance to a vantage point of their own."""

    def __init__(self, rows: np.ndarray, most: float, leaf_rows: int = LEAF_ROWS):
        self.rows = rows
        flat = rows.astype(np.float64)
        self.height = np.sqrt(np.maximum(most - (flat**2).sum(1), 0))
        parts, self.points, steps = [np.arange(len(rows))], [], [[]]
        for _ in range(max(0, math.ceil(math.log2(max(1, len(rows)) / leaf_rows)))):
            halves, taken = [], []
            for part, path in zip(parts, steps):
                away = self._distance(flat, part, part[0])
                point = part[np.argmax(away)]  # a corner of the part: its shells cut thinner than those of the middle
                away = self._distance(flat, part, point)
                split = np.argpartition(away, len(part) // 2)
                self.points.append(point)
                for half in (split[: len(part) // 2], split[len(part) // 2 :]):
                    halves.append(part[half])
                    taken.append([*path, (len(self.points) - 1, away[half].min(), away[half].max())])
            parts, steps = halves, taken
        self.leaves, self.depth = parts, len(steps[0])
        shells = np.array(steps, float).reshape(len(parts), self.depth, 3)
        self.at, self.near, self.far = shells[..., 0].astype(int), shells[..., 1], shells[..., 2]

    def _distance(self, flat: np.ndarray, some: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(((flat[some] - flat[point]) ** 2).sum(1) + (self.height[some] - self.height[point]) ** 2)

    def bounds(self, queries: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest distance) of each query (which lies at height 0) to any row of each leaf."""
        if not self.depth:
            return np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
        square = (queries.astype(np.float64) ** 2).sum(1)[:, None] + most - 2 * queries.astype(np.float64) @ self.rows[self.points].astype(np.float64).T
        away = np.sqrt(np.maximum(square, 0))[:, self.at]
        return np.maximum(np.maximum(away - self.far, self.near - away).max(2), 0), (away + self.far).min(2)


class Search:
    """The best k rows of each request, over the blocks it is shown.

    A request is an anchor, whether it wants rows of the anchor's label or of others, and a window of scores. Best are higher
    scores, then smaller ids, null last.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, most: float):
        self.ids, self.labels, self.vectors, self.anchor, self.same, self.low, self.high, self.k, self.most = ids, labels, vectors, anchor, same, low, high, k, most
        self.floor = low.copy()  # what a row must score to be among the best
        self.full = np.zeros(len(anchor), bool)
        self.last_id, self.last_null = np.zeros(len(anchor), np.int64), np.zeros(len(anchor), bool)
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # request, score, null id, id

    def visit(self, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, tree: Tree) -> int:
        """Search one block; how many pairs of anchors and rows were scored."""
        least, greatest = tree.bounds(self.vectors, self.most)
        total = (self.vectors.astype(np.float64) ** 2).sum(1)[:, None] + self.most
        slack = 0.5 + 1e-12 * total
        top, bottom = (total - least**2) / 2 + slack, (total - greatest**2) / 2 - slack
        top, bottom = top[self.anchor], bottom[self.anchor]
        entered = np.where((top >= self.low[:, None]) & (bottom <= self.high[:, None]), np.minimum(top, self.high[:, None]), -np.inf)
        order = np.argsort(-entered, axis=1, kind="stable")
        entered = np.take_along_axis(entered, order, 1)
        scores, known, scored = np.zeros((len(self.ids), len(ids)), np.int64), np.zeros((len(self.ids), len(tree.leaves)), bool), 0
        for step in range(len(tree.leaves)):
            active = np.flatnonzero(np.isfinite(entered[:, step]) & (entered[:, step] >= self.floor))
            if not len(active):
                break
            leaf, new = order[active, step], []
            for f in np.unique(leaf):
                own, rows = active[leaf == f], tree.leaves[f]
                who = np.unique(self.anchor[own])
                who = who[~known[who, f]]
                scores[np.ix_(who, rows)] = self.vectors[who] @ tree.rows[rows].T
                known[who, f] = True
                scored += len(who) * len(rows)
                a = self.anchor[own]
                s = scores[np.ix_(a, rows)]
                fits = (labels[rows] == self.labels[a, None]) == self.same
                fits &= (s >= self.floor[own, None]) & (s <= self.high[own, None]) & ((ids[rows] != self.ids[a, None]) | null[rows])
                tie = self.full[own, None] & (s == self.floor[own, None])
                before = np.where(null[rows] == self.last_null[own, None], ids[rows] < self.last_id[own, None], ~null[rows])
                r, c = np.nonzero(fits & (~tie | before))
                new.append((own[r], s[r, c], null[rows][c], ids[rows][c]))
            self._merge(new)
        return scored

    def _merge(self, new: list[tuple]) -> None:
        request, score, null, ids = (np.concatenate(x) for x in zip(self.found, *new))
        order = np.lexsort((ids, null, -score, request))
        request = request[order]
        first = np.searchsorted(request, np.arange(len(self.anchor)))
        nth = np.arange(len(request)) - first[request]
        keep = nth < self.k
        self.found = [request[keep], *(x[order][keep] for x in (score, null, ids))]
        last = self.found[0][nth[keep] == self.k - 1]
        self.full[last] = True
        at = nth[keep] == self.k - 1
        self.floor[last], self.last_null[last], self.last_id[last] = (x[at] for x in self.found[1:])


def _matrix(column: pa.ChunkedArray, wide: bool) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.int64 if wide else np.float64)


def _searched(stream: DataFrame, same: bool, k: int, most: float, low: int, high: int) -> DataFrame:
    """(aid, nth, anchor_id, wanted_id, wanted_score, id, score): the best k of each anchor (same) or of each of its wants, a lane.

    stream (qblock, lane, block, id, label, vec, aid, wants): of each (qblock, lane) the anchors as block -1, then the rows.
    """
    wide = most >= 2**52

    def begin(table: pa.Table) -> tuple[Search, list]:
        ids, labels, aid, wants = (table.column(c) for c in ("id", "label", "aid", "wants"))
        wants = [[(None, None)]] * len(table) if same else [[(w["positive_id"], w["positive_score"]) for w in x] for x in wants.to_pylist()]
        requests = [(n, k, *w) for n, own in enumerate(wants) for k, w in enumerate(own)]
        anchor = np.array([r[0] for r in requests], np.int64)
        lows = [-FAR if same else -(-low * r[3] // 100) for r in requests]
        highs = [FAR if same else high * r[3] // 100 for r in requests]
        search = Search(ids.to_numpy(), labels.to_numpy(), _matrix(table.column("vec"), wide), anchor, same, np.array(lows, np.int64), np.array(highs, np.int64), k, most)
        return search, [(aid[n].as_py(), nth, ids[n].as_py(), *w) for n, nth, *w in requests]

    def result(search: Search, names: list) -> pa.RecordBatch:
        request, score, null, ids = search.found
        about = list(zip(*(names[r] for r in request.tolist()))) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(x, t) for x, t in zip(about, kinds)] + [pa.array(ids, mask=null), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["aid", "nth", "anchor_id", "wanted_id", "wanted_score", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state = None, [], None

        def ended() -> None:
            """A whole block has come: anchors begin a search, rows go on with it."""
            nonlocal state
            table = pa.Table.from_batches(held)
            if now[2] < 0:
                state = begin(table)
            elif state:
                ids = table.column("id").combine_chunks()
                rows = _matrix(table.column("vec"), wide)
                state[0].visit(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), table.column("label").to_numpy(), Tree(rows, most))

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if key != now and now is not None:
                    ended()
                    held = []
                    if key[:2] != now[:2] and state:
                        yield result(*state)
                        state = None
                now = key
                held.append(batch.slice(a, b - a))
        if now is not None:
            ended()
            if state:
                yield result(*state)

    return stream.mapInArrow(run, "aid long, nth int, anchor_id long, wanted_id long, wanted_score long, id long, score long")


def usable(vectors: DataFrame, levels: float) -> DataFrame:
    """(id, label, vec) of the rows that take part: label and vector known, all components finite, of the commonest length; vec is floor(levels x)."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole & (F.size("embedding") > 0))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(levels) * x.cast("double")).cast("long"))
    rows = materialise(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vec.alias("vec")), "vectors")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length.n if length else 0))


def mine_hard_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, levels: float = LEVELS, block_rows: int = BLOCK_ROWS, tasks: int = TASKS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, embedding, label: a whole number).

    A row's score is its inner product with the anchor, components x taken as floor(levels x); higher comes first, ties by smaller
    vec_id, null last. Anchors are rows whose vec_id `every` divides; an anchor's positives are its first rows of the same label
    and another vec_id; for each, the first rows of another label whose score is from `low` to `high` hundredths of the positive's
    are returned (none if that is negative), all if there are fewer. Rows with a null label or vector, or a null or non-finite
    component, take no part, nor do empty vectors and those of another than the commonest length. Rows with a null vec_id are no
    anchors but may be found; rows that share a vec_id are rows of their own, and never each other's positives. Other columns,
    whatever their names, are ignored; an empty table gives no rows. Scores beyond 62 bits raise ValueError.

    Every anchor is compared, at worst, with every row: rows are sent once to each block of ANCHOR_ROWS anchors, so that what is
    moved grows with rows x anchors / ANCHOR_ROWS.
    """
    rows = usable(vectors, levels)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, most = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if most >= FAR:
        raise ValueError("scores don't fit 62 bits")
    blocks = max(1, -(-n // block_rows))
    anchors = materialise(rows.where(F.col("id") % every == 0).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    qblocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    lanes = min(blocks, -(-tasks // qblocks))
    dealt = rows.select(F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int").alias("block"), "id", "label", "vec")
    dealt = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"), (F.col("block") % lanes).alias("lane"), "block", "id", "label", "vec", F.lit(None).cast("long").alias("aid"))

    def stream(asking: DataFrame, wants: str) -> DataFrame:
        kind = "array<struct<positive_id: long, positive_score: long>>"
        own = asking.select(
            F.pmod(F.xxhash64("aid"), F.lit(qblocks)).cast("int").alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).alias("block"),
            "id", "label", "vec", "aid", F.expr(wants).cast(kind).alias("wants"),
        )
        both = own.unionByName(dealt.withColumn("wants", F.lit(None).cast(kind)))
        return both.repartition(max(1, lanes * qblocks), "qblock", "lane").sortWithinPartitions("qblock", "lane", "block")

    order = [F.desc("score"), F.asc_nulls_last("id")]
    found = _searched(stream(anchors, "null"), True, positives, most, low, high)
    nearest = found.withColumn("n", F.row_number().over(Window.partitionBy("aid").orderBy(*order))).where(F.col("n") <= positives)
    want = F.array_sort(F.collect_list(F.struct("n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))))
    wanted = nearest.where("score >= 0").groupBy("aid").agg(F.transform(want, lambda w: w.dropFields("n")).alias("wanted"))
    asking = materialise(anchors.join(wanted, "aid"), "asking")
    found = _searched(stream(asking, "wanted"), False, negatives, most, low, high)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("aid", "nth").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", F.col("wanted_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("wanted_score").alias("positive_score"), F.col("score").alias("negative_score"))
