"""Benchmark decontamination by template windows (operator 2).

Numbers, units and names become typed placeholders, so that a question asked again with other values has the same template.
Windows of templates are hashed and joined: the benchmark's window hashes are a sorted array that every task holds (its size
is bounded: a larger benchmark is searched for block by block), the documents' windows are looked up where they are read, and
no document is shuffled. A capitalised word that opens a sentence may be a name or not, so windows with one are looked up both
ways. A window of too few literal words for its template to tell anything is looked up with its values as they are; if it has
any literal word its template is looked up too, but then the whole item must be there, word for word but for the values. A
match must also fit: every slot value of an item must stand for one value of the document, and for no other value of the
item, wherever in the document its windows are; of pairings that contradict each other the one that more windows have holds,
and windows that contradict it don't count.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import mix, utf8
from sievework.llm.repeats import gram_hashes

WINDOW, LITERALS, LEAST = 8, 4, 4
COVERAGE = 0.5
RUN = 20  # words in a row that fit are enough, whatever part of the item they are
BLOCK_CHARS = 8_000_000  # of benchmark text that a task holds at a time
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons ml cl l litre litres liter liters "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % $ € £ usd eur gbp "
    "dollar dollars euro euros cent cents degree degrees kmh mph hz khz mhz ghz w kw kwh v a j kj cal kcal kb mb gb tb".split()
)
_NUMBER = regex.compile(r"^[$€£]?[+-]?\d[\d.,:/]*([\p{L}%°$€£]*)$")
_EDGES = regex.compile(r"^[^\p{L}\p{N}$€£%+-]+|[^\p{L}\p{N}$€£%]+$")
NUMBER, UNIT, CAPITAL, ENDS, EMPTY = 1, 2, 4, 8, 16
SLOTS = [np.uint64(xxhash.xxh64_intdigest(b"\0" + n)) for n in (b"number", b"unit", b"name")]


def describe(word: str) -> tuple[int, int, str]:
    """(hash of the bare word, flags, bare word in lower case)."""
    bare = _EDGES.sub("", word)
    flags = ENDS * (word.rstrip("\"'”’)]»")[-1:] in (".", "!", "?", ":"))
    low = bare.lower()
    if not low:
        return 0, flags | EMPTY, ""
    number = _NUMBER.match(low)
    if number and (not number[1] or number[1] in UNITS):
        flags |= NUMBER
    elif low in UNITS:
        flags |= UNIT
    elif bare[0].isupper() and (len(bare) == 1 or bare[1:].islower()):
        flags |= CAPITAL
    return xxhash.xxh64_intdigest(low), flags, low


@dataclass
class Parsed:
    """Texts as words, one after another: places in `names`, template tokens, the words' own hashes, slot kinds (0: none), sizes of
    the texts, whether a word opens a sentence, and tokens and kinds if capitalised openers were names."""

    words: np.ndarray
    tokens: np.ndarray
    plain: np.ndarray
    slot: np.ndarray
    sizes: np.ndarray
    opens: np.ndarray
    loose: np.ndarray
    loose_slot: np.ndarray
    names: list[str] | None = None

    @property
    def bare(self) -> list[str]:
        return [self.names[w] for w in self.words]

    def part(self, a: int, b: int) -> Parsed:
        """The words from a to b as one text."""
        cut = (v[a:b] for v in (self.words, self.tokens, self.plain, self.slot))
        return Parsed(*cut, np.array([b - a]), *(v[a:b] for v in (self.opens, self.loose, self.loose_slot)), self.names)


class Templates:
    """Template tokens of texts; what a word is, is worked out once as long as the memo lasts."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.hash, self.flags, self.bare = [], [], []

    @classmethod
    def of(cls, texts: list[bytes]) -> Parsed:
        parse = cls()
        out = parse(texts)
        out.names = parse.bare
        return out

    def number(self, word: str) -> int:
        if (found := self.memo.get(word)) is None:
            h, f, low = describe(word)
            found = self.memo[word] = len(self.hash)
            self.hash.append(h)
            self.flags.append(f)
            self.bare.append(low)
        return found

    def __call__(self, texts: list[bytes]) -> Parsed:
        if len(self.memo) > 400_000:
            self.__init__()
        memo, parts = self.memo, []
        for text in texts:
            words = text.decode().split()
            for word in set(words).difference(memo):
                self.number(word)
            parts.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        used, words = np.unique(words, return_inverse=True) if len(words) < len(self.hash) else (np.arange(len(self.hash)), words)
        hashes = np.array([self.hash[i] for i in used] or [0], np.uint64)
        flags = np.array([self.flags[i] for i in used] or [0], np.uint8)[words] if len(words) else np.zeros(0, np.uint8)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        full = flags & EMPTY == 0
        words, flags, doc = words[full], flags[full], doc[full]
        opens = np.ones(len(words), bool)
        opens[1:] = (flags[:-1] & ENDS > 0) | (doc[1:] != doc[:-1])
        number = flags & NUMBER > 0
        after_number = np.zeros(len(words), bool)
        after_number[1:] = number[:-1] & (doc[1:] == doc[:-1])
        unit = (flags & UNIT > 0) & after_number
        name = (flags & CAPITAL > 0) & ~opens & ~number & ~unit
        slot = number * 1 + unit * 2 + name * 3
        plain = hashes[words]
        tokens = plain.copy()
        for k in (1, 2, 3):
            tokens[slot == k] = SLOTS[k - 1]
        may = (flags & CAPITAL > 0) & opens & ~number & ~unit
        loose = tokens.copy()
        loose[may] = SLOTS[2]
        return Parsed(used[words], tokens, plain, slot, np.bincount(doc, minlength=len(parts)), opens, loose, np.where(may, 3, slot))


def window_hashes(x: Parsed, size: int, few: bool = True) -> list[tuple[np.ndarray | None, np.ndarray, bool]]:
    """(places or None for all, their hashes, whether the whole item must follow) of the windows of `size` tokens.

    First the template if it has enough literal words, else the words as they are; then the template with sentence openers as
    names, where there are any; then, apart from the others and only if wanted, that template where it has a few literal words.
    """
    least = min(LITERALS, (size + 1) // 2)
    literal = lambda slot: (c := np.concatenate([[0], np.cumsum(slot == 0)]))[size:] - c[:-size]
    hashes = gram_hashes(x.tokens, size)
    poor = literal(x.slot) < least
    if poor.any():
        hashes[poor] = mix(gram_hashes(x.plain, size)[poor])
    loose, left = gram_hashes(x.loose, size), literal(x.loose_slot)
    opener = np.concatenate([[0], np.cumsum(x.loose_slot != x.slot)])
    both = np.flatnonzero((opener[size:] > opener[:-size]) & (left >= least))
    out = [(None, hashes, False), (both, loose[both], False)]
    if few:
        poor = np.flatnonzero((left > 0) & (left < least))
        out.append((poor, mix(mix(loose[poor])), True))
    return out


def short_hashes(x: Parsed, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of `size` words as they are that make a sentence of their own; one word must be the whole text."""
    closes = np.append(x.opens[1:], True)
    sizes = np.repeat(x.sizes, x.sizes)
    alone = x.opens[: len(x.opens) - size + 1] & closes[size - 1 :]
    at = np.flatnonzero(alone & ((sizes[: len(alone)] == 1) if size == 1 else True))
    return at, mix(mix(mix(gram_hashes(x.plain, size)[at])))


class Benchmark:
    """The template windows of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        x = Templates.of([t.encode() for _, t in items])
        at, entries = 0, defaultdict(list)
        self.ids, self.values, self.loose, self.count = [i for i, _ in items], [], [], []
        for n, size in enumerate(x.sizes.tolist()):
            own = x.part(at, at + size)
            at += size
            self.values.append([(int(k), w) if k else None for k, w in zip(own.loose_slot, own.bare)])
            self.loose.append(own.loose)
            self.count.append(max(size - WINDOW, 0) + 1 if size else 0)
            if size >= LEAST:
                for places, hashes, whole in window_hashes(own, min(WINDOW, size)):
                    for q, h in enumerate(hashes.tolist()) if places is None else zip(places.tolist(), hashes.tolist()):
                        entries[min(WINDOW, size), h].append((n, q, whole))
            elif size:
                entries[size, int(short_hashes(own, size)[1][0])].append((n, 0, False))
        self.keys, self.entries = {}, {}
        for width in sorted({w for w, _ in entries}):
            self.keys[width] = np.array(sorted(h for w, h in entries if w == width), np.uint64)
            self.entries[width] = [entries[width, h] for h in self.keys[width].tolist()]
        self.few = {width for (width, _), own in entries.items() if any(whole for *_, whole in own)}

    def hits(self, x: Parsed) -> dict[tuple[int, int], set[tuple[int, int, int]]]:
        """By (document, item): (place in the document, place in the item, width) of every window that both have."""
        begin = np.concatenate([[0], np.cumsum(x.sizes)])
        out: dict = defaultdict(set)
        tried: set = set()
        for width, keys in self.keys.items():
            if len(x.tokens) < width:
                continue
            may = np.zeros(1 << 20, bool)
            may[keys & np.uint64((1 << 20) - 1)] = True
            for places, hashes, *_ in window_hashes(x, width, width in self.few) if width >= LEAST else [short_hashes(x, width)]:
                at = np.flatnonzero(may[hashes & np.uint64((1 << 20) - 1)])
                k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
                found = keys[k] == hashes[at]
                at, k = at[found], k[found]
                at = at if places is None else places[at]
                doc = np.searchsorted(begin, at, "right") - 1
                inside = at + width <= begin[doc + 1]
                for p, d, e in zip(at[inside].tolist(), doc[inside].tolist(), k[inside].tolist()):
                    p -= int(begin[d])
                    for n, q, whole in self.entries[width][e]:
                        if not whole:
                            out[d, n].add((p, q, width))
                        elif (d, n, p - q) not in tried:
                            tried.add((d, n, p - q))
                            out[d, n] |= self._whole(x, int(begin[d]), int(begin[d + 1]), n, p - q, width)
        return out

    def _whole(self, x: Parsed, begin: int, end: int, n: int, shift: int, width: int) -> set[tuple[int, int, int]]:
        """All windows of item n if it is there as a whole, `shift` words into the document, and its values fit; else none."""
        size = len(self.loose[n])
        if shift < 0 or begin + shift + size > end or not np.array_equal(x.loose[begin + shift : begin + shift + size], self.loose[n]):
            return set()
        every = {(q + shift, q, width) for q in range(self.count[n])}
        fits, _ = consistent(self.values[n], x.part(begin, end).bare, every)
        return every if len(fits) == len(every) else set()


def consistent(item: list, doc: list[str], hits: set[tuple[int, int, int]]) -> tuple[set[tuple[int, int]], bool]:
    """(windows that fit as (place in doc, in item), whether all values are the item's own) of all hits: (place in doc, in item, width).

    One map holds for document and item. Pairings of values hold in the order of how many windows have them (then in the order of
    the item, then of the document), unless one that holds already has either value; a window with a pairing that doesn't hold
    doesn't fit.
    """
    pairs = {(q, p): [(item[q + k], doc[p + k]) for k in range(width) if item[q + k] is not None] for p, q, width in hits}
    support: Counter = Counter(pair for at in sorted(pairs) for pair in set(pairs[at]))
    first = {pair: at for at in sorted(pairs, reverse=True) for pair in pairs[at]}
    to: dict = {}
    back: dict = {}
    for a, b in sorted(support, key=lambda x: (-support[x], first[x], x)):
        if a not in to and (a[0], b) not in back:
            to[a], back[a[0], b] = b, a
    fits = {(p, q) for (q, p), own in pairs.items() if all(to.get(a) == b for a, b in own)}
    return fits, all(a[1] == b for p, q in fits for a, b in pairs[q, p])


def longest_run(fits: set[int], width: int) -> int:
    """Words in the longest run of windows (by their place in the item) that follow each other."""
    best = run = 0
    for q in sorted(fits):
        run = run + 1 if q - 1 in fits else 1
        best = max(best, run)
    return best + width - 1 if best else 0


def _found(texts, benchmark: Benchmark, parse: Templates, coverage: float) -> Iterator[tuple[int, int, int, int, bool]]:
    """(row, item, windows found, item windows, verbatim) of every text that holds at least this part of an item."""
    step = 64
    for first in range(0, len(texts), step):
        x = parse([t.as_py() or b"" for t in texts[first : first + step]])
        x.names = parse.bare
        begin = np.concatenate([[0], np.cumsum(x.sizes)])
        bare: dict = {}
        for (d, n), hits in sorted(benchmark.hits(x).items()):
            if not hits:
                continue
            if d not in bare:
                bare[d] = x.part(begin[d], begin[d + 1]).bare
            fits, same = consistent(benchmark.values[n], bare[d], hits)
            covered = {q for _, q in fits}
            lines = defaultdict(set)
            for p, q in fits:
                lines[p - q].add(q)
            run = max((longest_run(own, next(iter(hits))[2]) for own in lines.values()), default=0)
            if covered and (len(covered) >= coverage * benchmark.count[n] or run >= RUN):
                yield first + d, n, len(covered), benchmark.count[n], same


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_chars characters; null ids and texts are no items."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(chars / block_chars))
    for k in range(count):
        yield sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, verbatim): the documents that hold benchmark items, and which.

    A document holds an item if at least `coverage` of the item's template windows occur in it and fit, or RUN words in a row
    do; verbatim is false where numbers, units or names differ. One map from the item's values to the document's holds for the
    whole document, so an item asked twice with different values is found by the one that more windows have. Windows of mostly
    numbers, units and names must occur as they are, or the whole item with other values; items of nothing else only as they are.
    Items shorter than a window are one window. Items of fewer than LEAST words must be a sentence of their own, word for word, and
    those of one word the whole text, as such words are in too many texts to tell anything. Null and empty texts hold nothing, repeated
    rows each count, a null doc_id is returned as null. Other columns are ignored. No items or no documents: no rows.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for items in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parse, bench = Templates(), shared.value
            for batch in batches:
                rows = list(_found(batch.column(1), bench, parse, coverage))
                if rows:
                    row, item, windows, of, verbatim = zip(*rows)
                    columns = [batch.column(0).take(pa.array(row)), pa.array([bench.ids[n] for n in item]), pa.array(windows, pa.int64()), pa.array(of, pa.int64())]
                    columns += [pa.array([w / o for w, o in zip(windows, of)]), pa.array(verbatim)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "windows", "item_windows", "coverage", "verbatim"])

        schema = f"doc_id {id_type}, item_id {item_type}, windows long, item_windows long, coverage double, verbatim boolean"
        found = docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that contaminated() would report; all columns are returned and nothing is shuffled.

    Null and empty texts stay, repeated rows go or stay together; no items drop nothing, and no documents give no rows.
    """
    for items in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))
        place = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            parse = Templates()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in _found(batch.column(place).cast(pa.binary()), shared.value, parse, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
