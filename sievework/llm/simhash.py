"""SimHash near-duplicates through a Gray-order hierarchical index (operator 4).

Fingerprints are computed map-side. Distinct ones are dealt to buckets by 16-bit blocks: fingerprints that differ in at
most three bits agree in one of four blocks. In each bucket they are sorted by Gray rank, which puts patterns that share
bits side by side; groups of eight become a node holding the bits all members share (mask and pattern), nodes of nodes
factor what their children share, and a search adds up differences on the way down and drops a whole group as soon as
they exceed the radius. A bucket with more than `bucket_rows` fingerprints isn't searched: its rows are dealt anew by
four blocks of the bits that aren't fixed yet (the same argument holds for those), so no bucket grows with the input.
Each bucket returns a spanning star per local component, never its pairs; components() joins the stars.

The pipeline's near-duplicates take their first links from the same index, over fingerprints of five-word shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialise, mix, ranges, release, starts, unused, utf8
from sievework.operators import similarity as joins
from sievework.operators.components import components

RADIUS, BUCKET_ROWS, FANOUT = 3, 4096, 8
HELD_ROWS = 1 << 18  # rows of a partition that are held at a time; over BUCKET_ROWS, so that a part of a hot bucket is known to be one
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of lower-cased words, repeats included; one for a shorter text, none for an empty one."""
    words = (text or b"").lower().split()
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), itertools.repeat(42)))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the fingerprint whose bits are set in over half of them; zero for an empty run.

    Bits are counted eight at a time in the byte lanes of a uint64, in blocks of at most 255 hashes.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full].astype(np.int64)
    blocks = -(-size // 255)
    begin, owner = ranges(np.zeros(len(full), np.int64), blocks)
    begin = begin * 255 + starts(size)[owner]
    first = starts(blocks)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (counts * 2 > size[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(shift)
    return out


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) of every document; a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fps = []
            for at in range(0, len(texts), 256):
                part = [shingle_hashes(t.as_py(), size) for t in texts[at : at + 256]]
                flat = np.fromiter(itertools.chain.from_iterable(part), np.uint64)
                fps.append(majority_bits(flat, np.fromiter(map(len, part), np.int64, len(part))))
            if fps:
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayForest:
    """One Gray-order tree per bucket; rows come sorted by bucket and Gray rank. All searches of a call run side by side.

    Levels run from the roots down; a level is (first child, children, pattern, own): own has the bits that all rows
    below a node share and that no ancestor has factored out already.
    """

    def __init__(self, fps: np.ndarray, sizes: np.ndarray):
        self.fps, self.levels = fps, []
        low = high = fps
        while True:
            blocks = -(-sizes // FANOUT)
            nth, tree = ranges(np.zeros(len(blocks), np.int64), blocks)
            first = nth * FANOUT + starts(sizes)[tree]
            count = np.minimum(FANOUT, sizes[tree] - nth * FANOUT)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            self.levels.append((first, count, low, ~(low ^ high)))
            sizes = blocks
            if (blocks == 1).all():
                break
        self.levels.reverse()
        above = np.zeros(len(sizes), np.uint64)
        for k, (first, count, pattern, shared) in enumerate(self.levels):
            self.levels[k] = (first, count, pattern, shared & ~above)
            above = np.repeat(shared, count)
        self.rest = ~above

    def search(self, query: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j), i < j, where i is in query and j in the tree (node) beside it, at most radius bits apart."""
        apart = np.zeros(len(query), np.int64)
        for first, count, pattern, own in self.levels:
            apart = apart + np.bitwise_count((self.fps[query] ^ pattern[node]) & own[node])
            near = apart <= radius
            query, node, apart = query[near], node[near], apart[near]
            node_rows, owner = ranges(first[node], count[node])
            query, apart, node = query[owner], apart[owner], node_rows
        later = node > query
        query, node, apart = query[later], node[later], apart[later]
        near = apart + np.bitwise_count((self.fps[query] ^ self.fps[node]) & self.rest[node]) <= radius
        return query[near], node[near]


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's label is a row of its component, its own label) after joining the components of a[i] and b[i]."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        differ = low != high
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(label, high[differ], low[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def bucket_stars(fps: np.ndarray, reps: np.ndarray, sizes: np.ndarray, radius: int, same=None) -> tuple[np.ndarray, np.ndarray]:
    """For buckets that lie one after another: (rep, smallest rep of its component within the bucket), without loops.

    same(i, j): which pairs the search returns count as links; all, if it isn't given.
    """
    order = np.lexsort((gray_rank(fps), np.repeat(np.arange(len(sizes)), sizes)))
    fps, reps = fps[order], reps[order]
    tree = np.repeat(np.arange(len(sizes)), sizes)
    forest, label = GrayForest(fps, sizes), np.arange(len(fps))
    cost = np.cumsum(sizes[tree])
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 2_000_000, "right")))
        i, j = forest.search(np.arange(at, to), tree[at:to], radius)
        if same is not None and len(i):
            keep = same(order[i], order[j])
            i, j = i[keep], j[keep]
        label = hook(label, i, j)
        at = to
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, reps)
    star = least[label]
    return reps[star != reps], star[star != reps]


def free_blocks(fps: np.ndarray, fixed: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of `parts` blocks of the bits not in fixed (one mask for all rows): the block's mask and the rows' values."""
    bits = [b for b in range(64) if not int(fixed) >> b & 1]
    for k in range(parts):
        block = sum(1 << b for b in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts])
        yield np.uint64(block), fps & np.uint64(block)


LINKS = "kind int, a long, b long, bucket long, fixed long"


def deal(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, rep, bucket, fixed) -> the same rows once for each of radius + 1 blocks of their free bits, with a new bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep, bucket, fixed = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp, fixed = fp.view(np.uint64), fixed.view(np.uint64)
            for mask in np.unique(fixed):
                own = fixed == mask
                for block, value in free_blocks(fp[own], mask, radius + 1):
                    key = mix(mix(bucket[own].view(np.uint64) ^ mix(block + np.zeros(1, np.uint64))) ^ value)
                    both = np.full(own.sum(), mask | block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)) for x in (fp[own], rep[own], key, both)], ["fp", "rep", "bucket", "fixed"]
                    )

    return rows.select("fp", "rep", "bucket", "fixed").mapInArrow(run, "fp long, rep long, bucket long, fixed long")


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """nodes (fp, rep; distinct fps) -> (a, b): enough links to join every two reps that a chain of near patterns joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; some whole buckets are searched at a time. Of a hot bucket not even all rows are held."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > HELD_ROWS:
                table = pa.Table.from_batches(held)
                bucket = table.column(2).to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield from some(table.slice(0, cut))
                rest = table.slice(cut)
                while rest.num_rows > 2 * HELD_ROWS:  # hot whatever follows: pass part of it on, and keep enough to know it by
                    yield from some(rest.slice(0, HELD_ROWS))
                    rest = rest.slice(HELD_ROWS)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from some(pa.Table.from_batches(held))

    def some(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        fp, rep, bucket, fixed = (table.column(k).to_numpy() for k in range(4))
        fp = fp.view(np.uint64)
        _, sizes = np.unique(bucket, return_counts=True)
        each = np.repeat(sizes, sizes)
        left = 64 - np.bitwise_count(fixed.view(np.uint64))
        hot = (each > bucket_rows) & (left > radius + 1)
        one = (each > 1) & ~hot
        if one.any():
            a, b = bucket_stars(fp[one], rep[one], sizes[np.isin(starts(sizes), np.flatnonzero(one))], radius)
            none = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (none.astype(np.int32), a, b, none, none)], ["kind", "a", "b", "bucket", "fixed"])
        if hot.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.ones(hot.sum(), np.int32), fp[hot].view(np.int64), rep[hot], bucket[hot], fixed[hot])],
                ["kind", "a", "b", "bucket", "fixed"],
            )

    found = None
    rows = nodes.select("fp", "rep", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("fixed"))
    while True:
        out = materialise(deal(rows, radius).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, LINKS), "links")
        edges = out.where("kind = 0").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = out.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("rep"), "bucket", "fixed")
        if rows.isEmpty():
            return found


def near_groups(docs: DataFrame, size: int = 3, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the class of every document under chains of fingerprints at most radius bits apart.

    fingerprint is 16 lowercase hex digits, component_id the smallest doc_id of the class. A null, empty or blank text has
    fingerprint zero and is linked like any other. Rows with a null doc_id come back too and link their neighbours, but name no
    class: component_id is null where a class has no other rows. Repeated doc_ids keep their rows. Other columns of docs,
    whatever their names, are ignored; an empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, size), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius, bucket_rows))
    classes = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return fps.join(classes.join(named, "class").select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


SIMILARITY = 0.8


def sets_of(texts: DataFrame, size: int) -> Callable[[DataFrame], DataFrame]:
    """texts (node, content) -> what makes the shingle sets of some nodes (node), each once."""
    return lambda nodes: joins.shingle_sets(joins.wanted(texts, nodes), size)


def index_links(texts: DataFrame, size: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """texts (node, content) -> (a, b): links between near sets whose fingerprints the Gray-order index joins, each decided exactly.

    The index gives stars, not pairs: a node is compared with the first node of its fingerprint, and that one with the smallest
    of its component in each bucket. So there are at most radius + 2 comparisons a node, however large a group is, unless hot
    buckets are dealt anew. What a star misses, two near ends of a chain or sets whose fingerprints lie further apart, isn't here.
    """
    fps = materialise(fingerprints(texts, size, "content", "node"), "fingerprints").withColumnRenamed("doc_id", "node")
    firsts = materialise(fps.groupBy("fp").agg(F.min("node").alias("rep")), "firsts")
    equal = fps.join(firsts, "fp").where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    pairs = materialise(links(firsts, radius).unionByName(equal).distinct(), "candidates")
    near = joins.near_links(pairs, sets_of(texts, size), similarity)
    for table in (fps, firsts, pairs):
        release(table)
    return near


def near_links(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """texts (node, content) -> (a, b): enough links to join every two nodes that chains of near sets join.

    First those of the Gray-order index. At a similarity of 0.8 fingerprints differ in about ten bits, more than an index of
    radius three reaches, so an exact join of the sets adds the links between the classes that these make; none is lost.
    """
    known = index_links(texts, size, similarity)
    return joins.joined_sets(joins.shingles(texts, size), similarity, sets_of(texts, size), known)


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document, the one with the smallest doc_id, of each group of near-duplicates.

    Texts are near when their sets of `size`-word shingles (lower-cased) have at least this Jaccard similarity; chains of
    near texts make a group. Texts without words (null, empty, blank) make one group. A null doc_id comes after all others; rows
    that agree in doc_id and text count as one document. All columns are returned, whatever their names; an empty table gives
    no rows.
    """
    id_ = F.col("doc_id").cast("long")
    rid, nth = unused(docs.columns, "rid", "nth")
    rows = docs.withColumn(rid, F.coalesce(id_, F.lit(2**62) + F.xxhash64("text").bitwiseAND(F.lit(2**61 - 1))))
    own = joins.contents(rows, rid, "text").select("id", "content", F.when(F.col("content").isNotNull(), F.xxhash64("content")).alias("node"))
    own = materialise(own, "contents")
    nodes = materialise(own.groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    links_ = near_links(own.where("content is not null").select("node", "content"), size, similarity)
    joined = components(links_)
    classes = nodes.join(joined, "node", "left")
    kept = materialise(classes.groupBy(F.coalesce("component", "node")).agg(F.min("rep").alias(rid)).select(rid), "kept")
    for table in (own, nodes, links_, joined):
        release(table)
    once = Window.partitionBy(rid).orderBy(F.xxhash64("text"))
    stay = rows.join(kept, rid, "left_semi").withColumn(nth, F.row_number().over(once))
    return stay.where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
