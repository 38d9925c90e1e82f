"""Exact repeats of fixed-length windows across a corpus; the engine of operators 8 (bytes) and 10 (words).

A window is `length` consecutive tokens. Texts are gathered into blocks of a few MB. Blocks ask about keys, sorted and each
once a block however often it comes; a key's place in the hash order gives the segment (one suffix bucket) that answers, and
a task sorts one segment after another. Segments are as many as the keys need, so that none grows with the input, and a
string that a third of all rows hold reaches its segment at most once from each block. Two rounds of asking tell all:

1. Words (estimates): the keys are cells of a count-min sketch, one row with 2^32 cells a segment, kept sparse. Blocks send
   their partition sketches, segments merge them and answer which cells count two or more. Counts are never too low, so no
   window that repeats is lost.
   Bytes (cover): a window's sample is the `gram`-long piece in it with the smallest hash, leftmost first, so that equal
   windows have equal samples at equal places (a string synchronising set, the content-defined kin of a difference cover).
   Consecutive windows with one sample form a run. Segments name each sample by the text of its run. A name that an earlier
   document has too settles all windows of the run at once, however long the tie; a run needs a closer look only if an
   earlier document has its sample within another text.
2. Windows that round 1 leaves open are compared exactly. Words (estimated as repeated): grouped by 96 bits of a hash. Bytes
   (runs that need the closer look): a run's text is sent to the segment of its sample, where the windows of one bucket, the
   runs of a sample, are sorted after another's as byte strings. Only windows of a sample with more texts than one place
   should sort are grouped by their hashes instead.

Between the rounds a block is read twice, never in more than one task, and nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sievework.llm.common import in_buckets, materialise, mix, ranges, release, settings, starts, unused, utf8

CHUNK = 1 << 19  # tokens that are hashed at a time
BLOCK_BYTES, SEGMENT_KEYS = 1 << 22, 1 << 19  # text in a block; keys in a segment, about
#: A block is one row: so many of them at a time would fill an executor.
LIGHT = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "8"}
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION, LOW = np.uint64((1 << 24) - 1), np.uint64(0xFFFFFFFF)
#: Texts that a sample may have to be sorted in one bucket; windows of the others are grouped by their hashes, just as exactly.
BUCKET_TEXTS, BLOCK_WINDOWS, SEGMENT_TEXTS = 4096, 200_000, 1 << 16
#: Segments of texts are numbered from here.
TEXTS = 1 << 30


@dataclass(frozen=True)
class Kind:
    """What a token is. parse: text -> (tokens, text between token i and j as bytes); length, gram: in tokens."""

    words: bool
    length: int
    gram: int
    bytes_per_token: float


class Tokens:
    """Turns texts into token hashes; equal words are hashed once as long as the memo lasts."""

    def __init__(self, kind: Kind):
        self.kind, self.memo = kind, {}
        self.table = mix(np.arange(1, 257, dtype=np.uint64))

    def split(self, text: bytes):
        return text.split() if self.kind.words else text

    def hashes(self, tokens) -> np.ndarray:
        if not self.kind.words:
            return self.table[np.frombuffer(tokens, np.uint8)]
        memo = self.memo
        if len(memo) > 400_000:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            for word in tokens:
                if word not in memo:
                    memo[word] = xxhash.xxh64_intdigest(word)
            return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))

    def payload(self, tokens, begin: int, end: int) -> bytes:
        return b" ".join(tokens[begin:end]) if self.kind.words else tokens[begin:end]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` consecutive tokens: a polynomial built from blocks of powers of two, scrambled."""
    power, block, done, size = BASE, tokens, None, 1
    with np.errstate(over="ignore"):
        while True:
            if gram & size:
                if done is None:
                    done, done_size = block, size
                else:
                    n = len(tokens) - done_size - size + 1
                    done, done_size = done[:n] * power + block[done_size : done_size + n], done_size + size
            if size * 2 > gram:
                return mix(done)
            block = block[:-size] * power + block[size:]
            power, size = power * power, size * 2


def sample_runs(tokens: np.ndarray, sizes: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, sample) of every run; tokens: those of all documents, each at least a window long."""
    begin = starts(sizes)
    grams = gram_hashes(tokens, kind.gram)
    packed = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed, kind.length - kind.gram + 1)
    first = np.empty(len(least), bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    first[begin] = True
    last = begin + sizes - kind.length  # of each document's windows
    for end in last[:-1]:
        first[end + 1 : end + kind.length] = False
    at = np.flatnonzero(first)
    doc = np.searchsorted(begin, at, "right") - 1
    after = np.append(at[1:], len(least))
    return doc, at - begin[doc], np.minimum(after, last[doc] + 1) - at, grams[least[at] & POSITION]


def documents_runs(texts, parse: Tokens) -> Iterator[tuple]:
    """(row, tokens, first windows, windows, samples) for the rows of a block, some rows at a time."""
    kind, held, size = parse.kind, [], 0

    def flush():
        if held:
            doc, at, count, sample = sample_runs(np.concatenate([h for *_, h in held]), np.array([len(h) for *_, h in held]), kind)
            cut = np.searchsorted(doc, np.arange(len(held) + 1))
            for k, (row, tokens, _) in enumerate(held):
                own = slice(cut[k], cut[k + 1])
                yield row, tokens, at[own], count[own], sample[own]
            held.clear()

    for row, text in enumerate(texts):
        tokens = parse.split(text.as_py())
        if len(tokens) >= kind.length:
            held.append((row, tokens, parse.hashes(tokens)))
            size += len(tokens)
        if size >= CHUNK:
            yield from flush()
            size = 0
    yield from flush()


def keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")]


def keyed(docs: DataFrame, *rest: Column) -> DataFrame:
    """(d, k, t, id): doc_id, null after all others; a hash that tells rows of one doc_id apart; the text's bytes; doc_id as it is.

    Other columns may follow.
    """
    d, k = keys()
    return docs.select(d.alias("d"), k.alias("k"), utf8("text").alias("t"), F.col("doc_id").cast("long").alias("id"), *rest)


BLOCKS = ["block", "size", "pieces", "d", "k", "off", "whole", "id", "t"]


def blocks(rows: DataFrame, kind: Kind) -> DataFrame:
    """keyed() rows, about BLOCK_BYTES of text in each block: (block, size, pieces, d, k, off, whole, id, t), the last six arrays.

    A longer text is cut into pieces that overlap by a window less a token, so that every window lies in one of them; off
    is the place of a piece's first token, whole tells rows that aren't pieces, and pieces counts the others. A fifth column
    of rows comes along as an array of the same name, null for pieces.
    """
    carried = rows.columns[4:]
    names = [*BLOCKS, *carried]

    def pieces(d: int, k: int, id_: int | None, text: bytes) -> Iterator[tuple]:
        parse = Tokens(kind)
        tokens = parse.split(text)
        step = max(1, int(BLOCK_BYTES / kind.bytes_per_token))
        for at in range(0, max(1, len(tokens) - kind.length + 1), step):
            yield d, k, at, False, id_, parse.payload(tokens, at, at + step + kind.length - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        taken, others = [], []  # rows of this batch whose fifth column is wanted, and what was taken of the batches before

        def take() -> None:
            if carried and taken:
                others.append(batch.column(4).take(pa.array(taken, pa.int64())))
            taken.clear()

        def flush() -> pa.RecordBatch:
            types = [pa.list_(t) for t in (*(pa.int64(),) * 3, pa.bool_(), pa.int64(), pa.binary())]
            count = pa.array([sum(not r[3] for r in held)])
            columns = [pa.array([block]), pa.array([size]), count, *(pa.array([c], t) for c, t in zip(zip(*held), types))]
            take()
            if carried:
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(others)))
                others.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for i, (d, k, text, id_) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                text = text or b""
                for row in pieces(d, k, id_, text) if len(text) > BLOCK_BYTES else [(d, k, 0, True, id_, text)]:
                    held.append(row)
                    taken.append(i if row[3] else None)
                    size += len(row[-1])
                    if size >= BLOCK_BYTES:
                        yield flush()
                        block, held, size = block + 1, [], 0
            take()
        if held:
            yield flush()

    schema = StructType.fromDDL("block long, size long, pieces long, d array<long>, k array<long>, off array<long>, whole array<boolean>, id array<long>, t array<binary>")
    for name in carried:
        schema = schema.add(name, ArrayType(rows.schema[name].dataType))
    return rows.mapInArrow(pack, schema)


def packed(*columns: np.ndarray) -> bytes:
    """64-bit columns as bytes, those of like weight together, which Spark's compression makes good use of."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)


def unpacked(data: bytes, *sizes: int) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel())
        at += 8 * n
    return out


def segment_of(key: np.ndarray, count: int) -> np.ndarray:
    """The segment of a hash: its place in the order of all hashes, so segments of sorted keys come in order."""
    return ((key >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns begin a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def asked(segment: np.ndarray, block: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """(seg, block, n, data) of sorted keys, a row a segment."""
    cut = np.flatnonzero(firsts(segment))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(segment)).tolist()):
        yield int(segment[a]), block, b - a, packed(*(c[a:b] for c in columns))


ASKED = "seg int, block long, n int, data binary"


def emit(rows: list[tuple], schema: tuple = (("seg", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary()))) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], [n for n, _ in schema])


def answered(questions: DataFrame, judge, segments: int, begin: int = 0) -> DataFrame:
    """(block, replies): for each block the answers of its segments; judge([(n, data), ...]) tells a whole segment's, a reply a row.

    Segments are numbered from begin, and each has a task of its own: by a hash, some tasks would get many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            rows = [(block, now, reply) for (block, *_), reply in zip(held, judge([x[1:] for x in held]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["block", "seg", "reply"])

        for batch in batches:
            for i, (seg, block, n) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if seg != now and held:
                    yield flush()
                    held = []
                now = seg
                held.append((block, n, batch.column(3)[i].as_py()))
        if held:
            yield flush()

    replies = questions.repartitionById(segments, F.col("seg") - begin).sortWithinPartitions("seg").mapInArrow(run, "block long, seg int, reply binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("seg", "reply")).alias("replies"))  # at most a block's keys


def judged_keys(width: int, answer):
    """A judge of keys in `width` columns; one byte a key."""

    def judge(rows: list[tuple[int, bytes]]) -> Iterator[bytes]:
        out = answer([np.concatenate(c) for c in zip(*(unpacked(data, *[n] * width) for n, data in rows))])
        at = 0
        for n, _ in rows:
            yield out[at : at + n].tobytes()
            at += n

    return judge


def joined_replies(replies, kind=np.uint8) -> np.ndarray:
    """A block's answers in the order of its keys."""
    return np.concatenate([np.frombuffer(r["reply"], kind) for r in sorted(replies or [], key=lambda r: r["seg"])] or [np.zeros(0, kind)])


@dataclass
class Runs:
    """Runs of a block's windows: document (its place in the block), first window, number of windows."""

    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray


class Cover:
    """Round 1 for bytes: runs of windows that share a sample; keys are samples with the text of their run."""

    width = 3

    def __init__(self, kind: Kind):
        self.kind = kind

    def keys_of(self, size: int) -> float:
        return 2 * size / self.kind.bytes_per_token / (self.kind.length - self.kind.gram + 2)

    def read(self, d: np.ndarray, texts, segments: int) -> None:
        """Set runs, the sorted distinct keys with their segments, and which key each run has."""
        kind, parse, parts, names = self.kind, Tokens(self.kind), [], []
        for row, tokens, at, count, sample in documents_runs(texts, parse):
            parts.append((np.full(len(at), row), at, count, sample))
            spans = zip(at.tolist(), (at + count + kind.length - 1).tolist())
            names.append(np.fromiter((xxhash.xxh3_64_intdigest(parse.payload(tokens, i, j)) for i, j in spans), np.uint64, len(at)))
        doc, at, count, sample = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(4))
        name, first = np.concatenate(names or [np.zeros(0, np.uint64)]), d[doc.astype(np.int64)]
        sample = mix(sample.astype(np.uint64))  # the smallest hashes of windows are small ones; segments are dealt by even ones
        order = np.lexsort((first, name, sample))
        new = firsts(sample[order], name[order])
        self.runs, self.key = Runs(doc.astype(np.int64), at.astype(np.int64), count.astype(np.int64)), np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.lead = lead = order[new]
        self.columns = [sample[lead], name[lead], first[lead].view(np.uint64)]
        self.segment = segment_of(self.columns[0], segments)
        self.later = first > first[lead][self.key] if len(order) else np.zeros(0, bool)

    @staticmethod
    def answer(columns: list[np.ndarray], most: int) -> np.ndarray:
        """1: an earlier document has the sample in the same text; 2: its windows need comparing with those of the sample's other
        texts; 3: so do they, but the sample has more than `most` texts."""
        sample, name, first = columns[0], columns[1], columns[2].view(np.int64)
        order = np.lexsort((first, name, sample))
        s, f = sample[order], first[order]
        by_sample, by_text = firsts(s), firsts(s, name[order])
        of_sample, begin = np.cumsum(by_sample) - 1, np.flatnonzero(by_sample)
        whole = f > f[by_text][np.cumsum(by_text) - 1]
        open_ = ~whole & (f > np.minimum.reduceat(f, begin)[of_sample])
        closer = np.logical_or.reduceat(open_, begin)[of_sample] & ~whole
        many = (np.add.reduceat(by_text.astype(np.int64), begin) > most)[of_sample]
        out = np.empty(len(order), np.uint8)
        out[order] = whole + closer * np.where(many, 3, 2)
        return out

    def settle(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: whether all its windows repeat, whether they are compared by hashes, whether within its sample's bucket."""
        own = told[self.key]
        whole = (own == 1) | self.later
        return whole, (own == 3) & ~whole, (own == 2) & ~whole

    def texts(self, told: np.ndarray, texts) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(which keys, the texts of their runs, the place of a key among them)."""
        which = np.flatnonzero(told == 2)
        lead, runs, out = self.lead[which], self.runs, []
        for row, at, count in zip(runs.doc[lead].tolist(), runs.at[lead].tolist(), runs.count[lead].tolist()):
            out.append(texts[row].as_py()[at : at + count + self.kind.length - 1])
        place = np.full(len(told), -1, np.int64)
        place[which] = np.arange(len(which))
        return which, out, place


class Sketch:
    """Round 1 for words: a count-min sketch of all windows; keys are cells, with how often a block counts them (2: or more)."""

    width = 2

    def __init__(self, kind: Kind):
        self.kind = kind

    def keys_of(self, size: int) -> float:
        return size / self.kind.bytes_per_token

    def read(self, d: np.ndarray, texts, segments: int) -> None:
        parse, length, rows, tokens = Tokens(self.kind), self.kind.length, [], []
        for row, text in enumerate(texts):
            words = parse.split(text.as_py())
            if len(words) >= length:
                rows.append(row)
                tokens.append(parse.hashes(words))
        sizes = np.array([len(h) for h in tokens], np.int64)
        begin, owner = ranges(starts(sizes), sizes - length + 1) if rows else (np.zeros(0, np.int64),) * 2
        self.tokens, self.place = np.concatenate(tokens or [np.zeros(0, np.uint64)]), begin
        self.runs = Runs(np.array(rows, np.int64)[owner], begin - starts(sizes)[owner] if rows else begin, np.ones(len(begin), np.int64))
        window = gram_hashes(self.tokens, length)[begin] if rows else self.tokens
        cell = segment_of(window, segments).view(np.uint64) << np.uint64(32) | window & LOW
        order = np.argsort(cell)
        new = firsts(cell[order])
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        cells = cell[order][new]
        self.segment = (cells >> np.uint64(32)).astype(np.int64)
        self.columns = [cells & LOW, np.minimum(np.bincount(self.key), 2).astype(np.uint64)]

    @staticmethod
    def answer(columns: list[np.ndarray], most: int) -> np.ndarray:
        return repeated_keys(columns[:1], columns[1])

    def settle(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = told[self.key] > 0
        return np.zeros(len(own), bool), own, np.zeros(len(own), bool)


def repeated_keys(columns: list[np.ndarray], times: np.ndarray) -> np.ndarray:
    """1 for keys that come at least twice in all."""
    order = np.lexsort(columns[::-1])
    new = firsts(*(c[order] for c in columns))
    out = np.empty(len(order), np.uint8)
    out[order] = (np.add.reduceat(times[order], np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
    return out


def earlier_keys(columns: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """1 for keys that an earlier document has too."""
    first = first.view(np.int64)
    order = np.lexsort(columns[::-1])
    new = firsts(*(c[order] for c in columns))
    out = np.empty(len(order), np.uint8)
    out[order] = first[order] > np.minimum.reduceat(first[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def judged_texts(length: int):
    """A judge of texts with their samples: of each, a bit for every window that a text with a smaller `first` has too.

    The bucket of a sample is sorted at a time (or some small ones together): all its windows as byte strings, so that equal
    ones meet.
    """

    def bucket(sample, first, parts) -> np.ndarray:
        sizes = np.array([len(p) - length + 1 for p in parts], np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        off = np.arange(len(owner)) - starts(sizes)[owner]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        at = starts(sizes + length - 1)[owner] + off
        rows = np.zeros((len(owner), -(-length // 8) * 8), np.uint8)
        rows[:, :length] = np.lib.stride_tricks.sliding_window_view(flat, length)[at]
        columns = [sample[owner], *rows.view(">u8").astype(np.uint64).T]
        order = np.lexsort(columns[::-1])
        new = firsts(*(c[order] for c in columns))
        own = first[owner][order]
        hit = own > np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
        out = np.zeros(len(parts), np.uint64)
        np.bitwise_or.at(out, owner[order][hit], np.uint64(1) << off[order][hit].astype(np.uint64))
        return out

    def judge(rows: list[tuple[int, bytes]]) -> Iterator[bytes]:
        samples, starting, sizes, flat = [], [], [], []
        for n, data in rows:
            sample, first, size = unpacked(data, n, n, n)
            samples.append(sample)
            starting.append(first)
            sizes.append(size.view(np.int64))
            flat.append(data[24 * n :])
        sample, first, size, flat = np.concatenate(samples), np.concatenate(starting).view(np.int64), np.concatenate(sizes), b"".join(flat)
        begin, order = starts(size), np.argsort(sample, kind="stable")
        out, at = np.zeros(len(order), np.uint64), 0
        edges = np.append(np.flatnonzero(firsts(sample[order]))[1:], len(order))  # where buckets end
        total = np.append(0, np.cumsum((size - length + 1)[order]))
        while at < len(order):
            to = int(edges[min(len(edges) - 1, np.searchsorted(total[edges], total[at] + BLOCK_WINDOWS))])
            own = order[at:to]
            out[own] = bucket(sample[own], first[own], [flat[b : b + n] for b, n in zip(begin[own].tolist(), size[own].tolist())])
            at = to
        at = 0
        for n, _ in rows:
            yield out[at : at + n].tobytes()
            at += n

    return judge


def window_keys(reader: Cover | Sketch, texts, which: np.ndarray) -> list[np.ndarray]:
    """96 bits of a hash, as two columns, of each window of the reader's runs `which`, one run after another."""
    kind, runs = reader.kind, reader.runs
    if kind.words:
        other = mix(reader.tokens ^ BASE)
        found = [gram_hashes(x, kind.length)[reader.place[which]] if len(which) else np.zeros(0, np.uint64) for x in (reader.tokens, other)]
        return [found[0], found[1] & LOW]
    out, text, last = [], b"", -1
    for row, at, count in zip(runs.doc[which].tolist(), runs.at[which].tolist(), runs.count[which].tolist()):
        if row != last:
            text, last = texts[row].as_py(), row
        out.append(b"".join([xxhash.xxh3_128_digest(text[i : i + kind.length]) for i in range(at, at + count)]))
    h = np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)
    return [h[:, 0].copy(), h[:, 1] & LOW]


def merged(doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that touch or overlap joined: (document, first window, windows), sorted."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + count)[order]
    if not len(doc):
        return doc, at, end
    base = (doc - doc[0]) * (int(end.max()) + 2)  # so that a document's ends lie below the next one's starts
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, (at + base)[1:] > reach[:-1])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(doc)) - 1
    return doc[lead], at[lead], reach[last] - base[lead] - at[lead]


def _rounds(docs: DataFrame, kind: Kind, earlier: bool, *rest: Column) -> tuple[DataFrame, int, DataFrame]:
    """The blocks, how many pieces of long texts they hold, and what each block was told: (block, data, replies, masks).

    Blocks are stored in buckets by their number, so that answers come to the texts and no join deals texts.
    """
    if earlier == kind.words:
        raise ValueError("words are compared with all other places, bytes with earlier documents")
    reader = Cover if earlier else Sketch
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # segments, so that no task is without one
    stored = in_buckets(blocks(keyed(docs, *rest), kind), "block", least, "blocks")
    size, pieces = (x or 0 for x in stored.agg(F.sum("size"), F.sum("pieces")).first())
    segments = max(least, int(reader(kind).keys_of(size) / SEGMENT_KEYS) + 1)

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = reader(kind)
                own.read(batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values, segments)
                if len(own.segment):
                    yield emit(list(asked(own.segment, batch.column(0)[i].as_py(), own.columns)))

    first = materialise(answered(stored.select("block", "d", "t").mapInArrow(first_round, ASKED), judged_keys(reader.width, partial(reader.answer, most=BUCKET_TEXTS)), segments), "first")

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a segment ask about windows; the row without one, of segment -1, keeps what the block must remember."""
        for batch in batches:
            for i in range(batch.num_rows):
                block, (d, k, off), texts = batch.column(0)[i].as_py(), (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3)), batch.column(4)[i].values
                own = reader(kind)
                own.read(d, texts, segments)
                told = joined_replies(batch.column(5)[i].as_py())
                whole, closer, bucketed = own.settle(told)
                rows = []
                if bucketed.any():
                    asking, pieces, place = own.texts(told, texts)
                    sample, _, first = (c[asking] for c in own.columns)
                    segment = segment_of(sample, text_parts)
                    cut = np.append(np.flatnonzero(firsts(segment)), len(segment)).tolist()
                    for a, b in zip(cut[:-1], cut[1:]):
                        size = np.array([len(x) for x in pieces[a:b]], np.int64)
                        rows.append((TEXTS + int(segment[a]), block, b - a, packed(sample[a:b], first[a:b], size) + b"".join(pieces[a:b])))
                    within = np.flatnonzero(bucketed)
                    marked = own.runs.doc[within], own.runs.at[within], own.runs.count[within], place[own.key[within]]
                else:
                    marked = (np.zeros(0, np.int64),) * 4
                which = np.flatnonzero(closer)
                columns = window_keys(own, texts, which)
                at, run = ranges(own.runs.at[which], own.runs.count[which])
                doc = own.runs.doc[which][run]
                value = d[doc]
                order = np.lexsort((value, columns[1], columns[0]))
                new = firsts(*(c[order] for c in columns))
                key = np.empty(len(order), np.int64)
                key[order] = np.cumsum(new) - 1
                lead = order[new]
                later = value > value[lead][key] if earlier else np.zeros(len(key), bool)
                value = value[lead] if earlier else np.minimum(np.bincount(key), 2)
                done = merged(*(np.concatenate(x) for x in zip((own.runs.doc[whole], own.runs.at[whole], own.runs.count[whole]), (doc[later], at[later], np.ones(later.sum(), np.int64)))))
                doc, at, key = doc[~later], at[~later], key[~later]
                if len(done[0]) or len(doc) or rows:
                    columns = [c[lead] for c in columns]
                    state = packed(np.array([len(d), len(done[0]), len(doc), len(marked[0])]), d, k, off, *done, doc, at, key, *marked)
                    yield emit([(-1, block, 0, state), *rows, *asked(segment_of(columns[0], parts), block, [*columns, value])])

    # more or fewer segments only change how much a task holds
    parts, text_parts = max(least, int(reader(kind).keys_of(size) / 2 / SEGMENT_KEYS) + 1), max(least, int(reader(kind).keys_of(size) / 16 / SEGMENT_TEXTS) + 1)
    told = stored.join(first, "block", "left").select("block", "d", "k", "off", "t", "replies")
    second = materialise(told.mapInArrow(second_round, ASKED), "second")
    release(first)
    closer = answered(second.where(f"seg >= 0 and seg < {TEXTS}"), judged_keys(3, lambda c: (earlier_keys if earlier else repeated_keys)(c[:2], c[2])), parts)
    buckets = answered(second.where(f"seg >= {TEXTS}"), judged_texts(kind.length), text_parts, TEXTS).withColumnRenamed("replies", "masks")

    kept = second.where("seg = -1").select("block", "data").join(closer, "block", "left").join(buckets, "block", "left")
    kept = materialise(kept.select("block", "data", "replies", "masks"), "told")
    release(second)
    return stored, pieces, kept


SPANS = "array<struct<start: long, windows: long>>"


def concluded(data: bytes, replies, masks) -> tuple[np.ndarray, ...]:
    """(d, k, off) of a block's rows, and of each with windows that repeat: its place in the block, where its spans begin among
    all, with one end more, and (start, windows) of all spans."""
    docs_, done, open_, runs_ = unpacked(data, 4)[0].view(np.int64).tolist()
    d, k, off, *parts = (x.view(np.int64) for x in unpacked(data, 4, *[docs_] * 3, *[done] * 3, *[open_] * 3, *[runs_] * 4)[1:])
    hit = joined_replies(replies)[parts[5]] > 0
    at, run = ranges(parts[7], parts[8])
    bits = joined_replies(masks, np.uint64)[parts[9]][run] >> (at - parts[7][run]).astype(np.uint64) & np.uint64(1)
    some = bits > 0
    found = parts[:3], (parts[3][hit], parts[4][hit], np.ones(hit.sum(), np.int64)), (parts[6][run][some], at[some], np.ones(some.sum(), np.int64))
    doc, at, count = merged(*(np.concatenate(x) for x in zip(*found)))
    lead = np.flatnonzero(firsts(doc)) if len(doc) else np.zeros(0, np.int64)
    return d, k, off, doc[lead], np.append(lead, len(doc)), at + off[doc], count


def span_lists(edges: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(windows)], ["start", "windows"]))


def told_spans(rows: int, data: bytes | None, replies, masks) -> pa.ListArray:
    """The spans of each of a block's rows; empty for rows without."""
    sizes, start, windows = np.zeros(rows, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if data is not None:
        *_, own, edges, start, windows = concluded(data, replies, masks)
        sizes[own] = np.diff(edges)
    return span_lists(np.append(0, np.cumsum(sizes)), start, windows)


def _marks(kept: DataFrame) -> DataFrame:
    def conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in zip(*(batch.column(i) for i in range(3))):
                d, k, off, own, edges, start, windows = concluded(*(x.as_py() for x in told))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(k[own]), pa.array(off[own]), span_lists(edges, start, windows)], ["d", "k", "off", "spans"])

    found = kept.select("data", "replies", "masks").mapInArrow(conclude, f"d long, k long, off long, spans {SPANS}")
    # rows that agree in doc_id and text have the same spans; pieces of one text are put together
    once = found.groupBy("d", "k", "off").agg(F.first("spans").alias("spans"))
    return materialise(once.groupBy("d", "k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "marks")


def repeated(docs: DataFrame, kind: Kind, earlier: bool, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = f"id long, t binary, spans {SPANS}") -> DataFrame:
    """(id, t, spans): doc_id as it is, the text's bytes (empty for null), and its windows that repeat, or null.

    With finish, what it makes of batches of these rows, in that schema: a block's at a time where the texts are read, so that
    no later step, with batches as large as the session's, takes whole texts through Python again. Texts are taken from their
    blocks, where what was told of them comes to; only texts longer than a block are dealt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole, ids, texts = (batch.column(k)[i].values for k in range(3))
                spans = told_spans(len(ids), *(batch.column(k)[i].as_py() for k in (3, 4, 5)))
                rows = pa.RecordBatch.from_arrays([ids, texts, spans], ["id", "t", "spans"]).filter(whole)
                yield finish(rows) if finish else rows

    def run_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield finish(batch.slice(i, 1)) if finish else batch.slice(i, 1)

    with settings(docs.sparkSession, LIGHT):
        stored, pieces, kept = _rounds(docs, kind, earlier)
        told = stored.join(kept, "block", "left").select("whole", "id", "t", "data", "replies", "masks")
        out = materialise(told.mapInArrow(run, schema), "texts")
        if pieces:
            long = keyed(docs).where(F.octet_length("t") > BLOCK_BYTES).join(_marks(kept), ["d", "k"], "left")
            out = out.unionByName(materialise(long.select("id", "t", "spans").mapInArrow(run_long, schema), "texts"))
    release(stored)
    release(kept)
    return out


def rewritten(docs: DataFrame, kind: Kind, earlier: bool, text: Callable[[bytes, tuple[np.ndarray, np.ndarray]], bytes]) -> DataFrame:
    """docs with what text(bytes, spans) returns in place of each text with windows that repeat; all columns, whatever their names.

    As in repeated(), rows are taken from the blocks, with their other columns; only those with texts longer than a block are dealt.
    """
    place, fields = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(fields))).alias("rest")
    names = docs.columns

    def changed(texts, nulls: list[bool], spans: pa.ListArray) -> pa.Array:
        out = [None if none else t.as_py() if own is None else text(t.as_py(), own) for t, none, own in zip(texts, nulls, span_arrays(spans))]
        return pa.array([None if t is None else t.decode() for t in out], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole, texts, others = (batch.column(k)[i].values for k in range(3))
                spans, rows = told_spans(len(texts), *(batch.column(k)[i].as_py() for k in (3, 4, 5))), np.flatnonzero(whole.to_numpy(zero_copy_only=False))
                texts, others, spans = (x.take(pa.array(rows)) for x in (texts, others, spans))
                columns = [others.field(f"c{i}") for i in range(len(fields))]
                columns.insert(place, changed(texts, others.field("none").to_pylist(), spans))
                yield pa.RecordBatch.from_arrays(columns, names)

    def run_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            columns[place] = changed(columns[place].cast(pa.binary()), [False] * batch.num_rows, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(columns, names)

    with settings(docs.sparkSession, LIGHT):
        stored, pieces, kept = _rounds(docs, kind, earlier, rest)
        told = stored.join(kept, "block", "left").select("whole", "t", "rest", "data", "replies", "masks")
        out = materialise(told.mapInArrow(run, docs.schema), "texts")
        if pieces:
            at, name, spans = unused(names, "d", "k", "spans")
            d, k = keys()
            found = _marks(kept).withColumnsRenamed({"d": at, "k": name, "spans": spans})
            long = docs.where(F.octet_length(utf8("text")) > BLOCK_BYTES).withColumns({at: d, name: k}).join(found, [at, name], "left")
            out = out.unionByName(long.select(*(F.col(f"`{c}`") for c in names), spans).mapInArrow(run_long, docs.schema))
    release(stored)
    release(kept)
    return out


def span_arrays(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Each row's spans as (starts, windows), or None for a row without; no span becomes a Python object."""
    begin, windows = (column.values.field(name).to_numpy() for name in ("start", "windows"))
    edges = column.offsets.to_numpy()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield (begin[a:b], windows[a:b]) if b > a else None


def covered(spans: tuple[np.ndarray, np.ndarray] | None, size: int, length: int) -> np.ndarray:
    """Which of a document's tokens some repeated window covers."""
    if spans is None:
        return np.zeros(size, bool)
    begin, end = spans[0], spans[0] + spans[1] + length - 1
    edge = np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def removed(spans, size: int, length: int) -> np.ndarray:
    """covered() for spans that were collected."""
    return covered((np.array([s["start"] for s in spans], np.int64), np.array([s["windows"] for s in spans], np.int64)) if spans else None, size, length)
