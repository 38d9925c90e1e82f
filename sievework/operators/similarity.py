"""Near texts: an exact join of sets by Jaccard similarity, and the duplicate decision that rests on it.

Sets that are near enough share most of their tokens, so each set need only be looked up by a few of them, its prefix:
tokens in one order for all sets, as many as it can lack and one more. Only prefixes are shuffled, a fifth of all tokens at
0.8. Any order gives the same pairs; the one taken puts tokens that many sets share last. A pair that meets at a token is a
candidate if the sizes, the token's places in both sets and bitmaps of the sets leave room for the overlap that is
needed, and the numbers of tokens in each of some bins do; the overlap itself decides. A set whose token meets only sets that sizes
and places rule out isn't looked up by it, so that chance meetings, which grow with the square of the rows, end where they
are found. Who is near whom is asked only as far as the classes need it: the sets of a token are
first compared with one of them, the one with the fewest tokens before it, and then only those still in different classes with
each other, block by block. So a token that very many sets share costs a pair a set as long as they are near, and no task
holds all sets of a token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.components import components
from sievework.sources.shared import materialise, release

SHINGLE, SIMILARITY = 5, 0.8
#: Longs in a set's bitmap; sets of a token in one block; rounds with a leader, and the pairs a row that make another worth it.
MAP, BLOCK_SETS, ROUNDS, PAIRS_A_ROW = 8, 512, 3, 200
#: Sets of a token up to which all pairs of them are tried where they meet; the fewest and the most bins of a set, as powers of two.
MEETING, BINS = 48, (3, 12)
#: Bits of the map that tells which texts may be wanted, a power of two.
WANTED = 1 << 24
#: Tokens that are counted at a time, how often one must come among them to be told of, and how many the order knows of.
COUNTED, OFTEN, COMMON = 1 << 21, 4, 1 << 18


def contents(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, content): the lower-cased words (A to Z only; ASCII's white space parts them) joined by a space, null if there are none."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [b" ".join((t.as_py() or b"").lower().split()) or None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["id", "content"])

    own = rows.select(F.col(id_).alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    return own.mapInArrow(run, f"id {kind}, content binary").select("id", F.col("content").cast("string").alias("content"))


@dataclass(frozen=True)
class Made:
    """Sets that a task makes of its rows as it needs them: they don't pass through Spark, nor take a second Python worker."""

    rows: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _mapped(sets: DataFrame | Made, run: Callable, schema: str) -> DataFrame:
    """What run makes of batches (node, tokens)."""
    if isinstance(sets, DataFrame):
        return sets.select("node", "tokens").mapInArrow(run, schema)
    make = sets.make
    return sets.rows.mapInArrow(lambda batches: run(make(batches)), schema)


def wanted(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of texts (node, content) whose node is one of nodes (node), each node once.

    A bitmap of one size for any input leaves out most of the others where they lie, so that few texts are dealt; a join decides.
    """
    bit = nodes.select(F.pmod("node", F.lit(WANTED)).alias("bit"))
    parts = bit.groupBy(F.expr("bit div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect()  # WANTED bits at most
    bits = np.zeros(WANTED // 8, np.uint8)
    for part, own in parts:
        bits[part * 4096 : (part + 1) * 4096] = np.frombuffer(own, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & (WANTED - 1)
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    some = texts.select("node", "content").mapInArrow(run, "node long, content string")
    return some.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def shingle_sets(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """texts (node, content as contents() has it) -> (node, tokens): the set of 64-bit hashes of all runs of `size` words.

    Of the whole text if it has fewer words; none if it is null.
    """
    return _mapped(shingles(texts, size), lambda batches: batches, "node long, tokens array<long>")


def shingles(texts: DataFrame, size: int = SHINGLE) -> Made:
    """shingle_sets(), made as they are needed."""

    memo: dict[bytes, int] = {}
    factors = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(size)], np.uint64)

    def hashes(content: bytes | None) -> np.ndarray:
        words = content.split(b" ") if content else []
        if len(words) < size:
            return np.array([xxhash.xxh3_64_intdigest(content)] if words else [], np.uint64).view(np.int64)
        if len(memo) > 400_000:
            memo.clear()
        try:
            word = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(memo))
            word = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(words) - size + 1
        runs = sum((word[k : k + n] * factors[k] for k in range(1, size)), word[:n] * factors[0])
        runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(runs ^ (runs >> np.uint64(32))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [hashes(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "tokens"])

    return Made(texts.select("node", F.col("content").cast("binary").alias("t")), run)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the sets of a batch, and of which set each is."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(lists)), np.diff(ends))


def common_tokens(sets: DataFrame | Made) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many sets share, sorted, and how often each was told of; COMMON of them at most.

    They only make an order: which tokens are missing, or how exact the counts are, changes how many candidates there are, never
    which sets are found near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(count[many])], ["token", "sets"])

        for batch in batches:
            held.append(_flat(batch.column(1))[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    counts = _mapped(sets, run, "token long, sets long").groupBy("token").agg(F.sum("sets").alias("sets"))
    rows = counts.orderBy(F.desc("sets"), "token").limit(COMMON).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["sets"].to_numpy(np.int64)


def prefixes(sets: DataFrame | Made, similarity: float) -> DataFrame:
    """(token, node, n, pos) of the tokens by which a set is looked up: pos is the token's place, n the size of the set."""
    common, often = common_tokens(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, owner = _flat(batch.column(1))
            count = np.zeros(len(token), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, token), len(common) - 1)
                count = np.where(common[at] == token, often[at], 0)
            token = token[np.lexsort((token, count, owner))]
            n = np.bincount(owner, minlength=batch.num_rows)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            keep = pos <= (n - np.ceil(n * similarity - 1e-9).astype(np.int64))[owner]
            of = owner[keep]
            columns = pa.array(token[keep]), batch.column(0).take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(pos[keep].astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(columns), ["token", "node", "n", "pos"])

    return _mapped(sets, run, "token long, node long, n int, pos int")


def met(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """prefixes() rows without those that meet no other node's set at their token to which it may be near, each token of a node once.

    A task goes through its rows in the order of their tokens, so that rows are dealt only once. It tries all pairs of a token
    with up to MEETING nodes by sizes and places; the rows of a token with more all stay, and are passed on as they come.
    """
    names = ["token", "node", "n", "pos"]

    def may(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """_may_be_near(), without bitmaps."""
        room = np.minimum(n[i] - pos[i], n[j] - pos[j]) * (1 + similarity) >= (n[i] + n[j]) * similarity - 1e-9
        return room & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * similarity - 1e-9)

    def kept(c: list[np.ndarray], large: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        token, _, n, pos = c
        keep, at, k = large.copy(), np.flatnonzero(~large), 1
        while len(at := at[sizes[at] > k]):
            i = at[at + k < len(token)]
            i = i[token[i + k] == token[i]]
            i = i[may(n, pos, i, i + k)]
            keep[i] = keep[i + k] = True
            k += 1
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None  # rows of the last token, which may go on; or if they are many, and went out: the last row, and the token

        def out(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(c[0]):
                begin = np.flatnonzero(np.append(True, c[0][1:] != c[0][:-1]))
                size = np.diff(np.append(begin, len(c[0])))
                sizes = np.repeat(size, size)
                large = sizes > MEETING
                if hot is not None:
                    large |= c[0] == hot
                if (keep := kept(c, large, sizes)).any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                c = [np.append(x, y) for x, y in zip(held, c)]
            fresh = np.append(True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]))
            if hot is not None:
                fresh[0] = False
            c = [x[fresh] for x in c]
            if not len(c[0]):
                continue
            cut = int(np.searchsorted(c[0], c[0][-1]))
            if len(c[0]) - cut > MEETING or c[0][-1] == hot:
                yield from out(c)
                held, hot = [x[-1:] for x in c], c[0][-1]
            else:
                yield from out([x[:cut] for x in c])
                held, hot = [x[cut:] for x in c], None
        if held is not None and hot is None:
            yield from out(held)

    return rows.select(names).repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, n int, pos int")


def described(sets: DataFrame | Made) -> DataFrame:
    """(node, map0.., tokens, bins): the bitmaps of the sets, their sizes, and how many tokens lie in each bin, 255 at most.

    The bins of a set, a byte each, grow in number with its size; those of half as many come by adding up both halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, owner = _flat(batch.column(1))
            maps, bits = np.zeros(batch.num_rows * MAP, np.uint64), token.view(np.uint64)
            np.bitwise_or.at(maps, owner * MAP + (bits % np.uint64(MAP)).astype(np.int64), np.uint64(1) << (bits // np.uint64(MAP) % np.uint64(64)))
            n = np.bincount(owner, minlength=batch.num_rows)
            bins = 1 << np.clip(np.log2(np.maximum(n, 1) / 4).astype(np.int64), *BINS)
            ends = np.cumsum(np.append(0, bins))
            place = (bits * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (bins - 1)[owner]
            counts = np.minimum(np.bincount(ends[owner] + place, minlength=ends[-1]), 255).astype(np.uint8)
            binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(counts)])
            columns = [batch.column(0), *map(pa.array, np.ascontiguousarray(maps.view(np.int64).reshape(-1, MAP).T)), pa.array(n.astype(np.int32)), binary]
            yield pa.RecordBatch.from_arrays(columns, ["node", *(f"map{k}" for k in range(MAP)), "tokens", "bins"])

    return _mapped(sets, run, "node long, " + ", ".join(f"map{k} long" for k in range(MAP)) + ", tokens int, bins binary")


def room_in_bins(pairs: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets' bins leave room for enough overlap: what the counts of two bins differ by is tokens that one lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(c.as_buffer(), np.uint8).astype(np.int32) for c in (x, y))
                least = min(len(x), len(y))
                differ = int(np.abs(x.reshape(-1, least).sum(0) - y.reshape(-1, least).sum(0)).sum())
                keep.append((n + m - differ) / 2 * (1 + similarity) >= (n + m) * similarity - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, n, bins: told.select(F.col("node").alias(node), F.col("tokens").alias(n), F.col("bins").alias(bins))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _may_be_near(x: str, y: str, similarity: float) -> Column:
    """Whether sizes, the shared token's places and the bitmaps of both sides leave room for enough overlap."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "n") + c(y, "n")
    enough = lambda overlap: overlap * (1 + similarity) >= both * similarity - 1e-9
    differ = sum((F.bit_count(c(x, f"map{k}").bitwiseXOR(c(y, f"map{k}"))) for k in range(1, MAP)), F.bit_count(c(x, "map0").bitwiseXOR(c(y, "map0"))))
    # of a near pair's meetings the first counts, before which the sets share nothing; a differing bit is a token that one of the two lacks
    overlap = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"), (both - differ) / 2)
    return (F.least(c(x, "n"), c(y, "n")) >= F.greatest(c(x, "n"), c(y, "n")) * similarity - 1e-9) & enough(overlap)


def _near(candidates: DataFrame, some: Callable[[DataFrame], DataFrame], similarity: float, told: DataFrame | None = None) -> DataFrame:
    """(a, b): the candidates (x.node, y.node) whose sets are near, each once, written.

    Only the sets of candidates are made; with told, which has each node's bins, only of those whose bins leave room.
    """
    x, y = F.col("x.node"), F.col("y.node")
    pairs = materialise(candidates.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "pairs")
    if told is not None:
        every, pairs = pairs, materialise(room_in_bins(pairs, told, similarity), "roomy")
        release(every)
    sets = materialise(some(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    side = lambda node, tokens, n: sets.select(F.col("node").alias(node), F.col("tokens").alias(tokens), F.size("tokens").alias(n))
    both = pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = materialise(both.where(F.col("common") >= similarity * (F.col("nx") + F.col("ny") - F.col("common")) - 1e-9).select("a", "b"), "links")
    release(pairs)
    release(sets)
    return links


def near_links(pairs: DataFrame, some: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are near, each once with the smaller node first; some: nodes (node) -> their sets, each once."""
    side = lambda c: F.struct(F.col(c).alias("node"))
    return _near(pairs.select(side("a").alias("x"), side("b").alias("y")), some, similarity)


def _within_blocks(rows: DataFrame, similarity: float, block_sets: int) -> DataFrame:
    """Candidates x, y of different classes at the same token; a token's sets are dealt to blocks, and each pair of blocks is a key."""
    count = rows.groupBy("token").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("blocks"))
    dealt = rows.join(count, "token").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    keep = ["token", "node", "n", "pos", "component", *(f"map{k}" for k in range(MAP))]
    left = dealt.select(*keep, F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.select(*keep, F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    one = (F.col("x.i") < F.col("x.j")) | (F.col("x.node") < F.col("y.node"))
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("token", "i", "j")]
    return left.alias("x").join(right.alias("y"), [*same, F.col("x.component") != F.col("y.component"), one, _may_be_near("x", "y", similarity)])


def similar_links(sets: DataFrame, similarity: float = SIMILARITY, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(a, b): links between near sets, enough to join every two nodes that a chain of near sets joins.

    sets (node: long, tokens: array of distinct longs); rows of one node have the same tokens. Near are sets of a Jaccard
    similarity of at least `similarity`, exactly. Empty and null sets are near none.
    """
    return joined_sets(sets, similarity, block_sets=block_sets)


def joined_sets(sets: DataFrame | Made, similarity: float, some: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None, block_sets: int = BLOCK_SETS) -> DataFrame:
    """similar_links().

    some: nodes (node) -> their sets, each once, where that is cheaper than taking them from all, or these are made. known: links (a, b) that are
    known already; they come back too, and nobody is compared within their classes.
    """
    if isinstance(sets, DataFrame):
        sets = sets.where(F.size("tokens") > 0)
        some = some or (lambda nodes: sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    rows = materialise(met(prefixes(sets, similarity), similarity), "lookups")
    maps = [f"map{k}" for k in range(MAP)]
    # bitmaps and bins only, and of all sets: they are small, and nothing is dealt to make them
    every = materialise(described(sets), "maps")
    told = materialise(every.join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "described")
    release(every)
    first = rows.join(told.select("node", *maps), "node")
    if known is None:
        first = first.withColumn("component", F.col("node"))
    else:
        first = first.join(components(known), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lookups, rows = rows, materialise(first, "prefixes")
    release(lookups)
    found, k, last = known, 0, False
    while True:
        # who comes first in the order has the fewest tokens that few others have; later rounds try others
        order = F.struct((F.lit(0) if k else F.col("pos")).alias("first"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "component", "pos", *maps)
        if not last:
            lead = rows.groupBy("token").agg(F.min(order).alias("lead")).select("token", "lead.*")
            same = [F.col("x.token") == F.col("y.token"), F.col("x.component") != F.col("y.component"), _may_be_near("x", "y", similarity)]
            leads = materialise(lead.drop("first", "h"), "leads")
            links = _near(rows.alias("x").join(leads.alias("y"), same), some, similarity, told)
            release(leads)
        else:
            links = _near(_within_blocks(rows, similarity, block_sets), some, similarity, told)
        found = links if found is None else found.unionByName(links)
        if last:
            release(rows)
            release(told)
            return found
        joined = components(found)
        now = rows.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        now = materialise(now, "labelled")
        release(joined)
        parts = now.groupBy("token", "component").agg(F.count("*").cast("double").alias("part"))
        mixed = parts.groupBy("token").agg(F.sum("part").alias("rows"), F.sum(F.col("part") * F.col("part")).alias("within"), F.count("*").alias("parts")).where("parts > 1")
        mixed = materialise(mixed, "mixed")
        count, cross = mixed.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("rows") - F.col("within")) / 2).first()
        rest = materialise(now.join(mixed.select("token"), "token", "left_semi"), "rest")
        release(rows)
        release(now)
        release(mixed)
        rows = rest
        if not count:
            release(rows)
            release(told)
            return found
        k += 1
        last = k == ROUNDS or cross <= PAIRS_A_ROW * count


def duplicate_decisions(rows: DataFrame, id_: str, text: str, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(id, decision, confidence, related_id, class_id) of every row.

    MATCH: a smaller id has the same words (A to Z in lower case, white space aside); that is related_id, the smallest such, and
    confidence is 1. PROBABLE_MATCH: a chain of texts near each other, each by a Jaccard similarity of `similarity` or more on
    sets of `size` words, leads to a smaller id; related_id is the smallest, confidence its similarity to this text, which along a
    chain may be lower. NO_MATCH otherwise. class_id is the smallest id of the class, or the row's own. Texts without words match
    nothing. Rows with a null id come back with what they match, but are related to nothing else; rows that share an id are
    judged each by its text. Other columns are ignored; an empty table gives no rows.
    """
    own = contents(rows, id_, text).select("id", "content", F.when(F.col("content").isNotNull(), F.xxhash64("content")).alias("node"))
    own = materialise(own, "contents")
    texts = own.where("content is not null").select("node", "content")
    some = lambda nodes: shingle_sets(wanted(texts, nodes), size)
    links = joined_sets(shingles(texts, size), similarity, some)
    joined = components(links).select("node", "component")
    firsts = own.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"))
    classes = materialise(firsts.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    least = classes.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("node", "first_id").alias("rep"), F.count("*").alias("texts")).where("texts > 1")
    members = materialise(classes.join(least, "component").select("node", "class_id", "rep"), "members")
    # one comparison a text of a class, with the class's first
    sets = materialise(some(members.select("node")), "sets")
    compared = members.where("node != rep").join(sets.select("node", "tokens"), "node").join(sets.select(F.col("node").alias("rep"), F.col("tokens").alias("others")), "rep")
    compared = compared.withColumn("common", F.size(F.array_intersect("tokens", "others"))).withColumn("all", F.size("tokens") + F.size("others") - F.col("common"))
    score = F.floor((20_000 * F.col("common") + F.col("all")) / (2 * F.col("all"))) / 10_000  # four digits, halves up
    known = classes.select("node", "first_id").join(members.drop("rep"), "node", "left").join(compared.select("node", score.alias("score")), "node", "left")
    known = materialise(known, "known")
    for table in (sets, members, classes):
        release(table)
    out = own.select("id", "node").join(known, "node", "left")
    later = lambda c: F.col(c).isNotNull() & (F.col("id").isNull() | (F.col(c) < F.col("id")))
    match, probable = later("first_id"), later("class_id")
    return out.select(
        F.col("id").alias(id_), F.when(match, "MATCH").when(probable, "PROBABLE_MATCH").otherwise("NO_MATCH").alias("decision"),
        F.when(match, F.lit(1)).when(probable, F.col("score")).cast("decimal(5,4)").alias("confidence"),
        F.when(match, F.col("first_id")).when(probable, F.col("class_id")).alias("related_id"), F.coalesce("class_id", "first_id", "id").alias("class_id"),
    )
