"""Fill-in-the-middle transformation (operator 11).

The ends of all tokens of a batch of texts are one bitvector over their bytes, packed into words, with a directory of the
ones before each block of eight words. A text's popcount is its number of tokens; selecting the two drawn ranks gives the
bytes where it is cut. Each row is worked out where it is read: nothing is shuffled, and a task holds some MB of text at a
time, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM, SEED = 50, 80, 42
PIECE_BYTES = 1 << 22  # of text whose bits are held at a time
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Bits:
    """Rank and select over a packed bitvector."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(bits) // 512 + 1) * 8, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones come before each of these places."""
        block, word, bit = at >> 9, at >> 6 & 7, (at & 63).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64) * (np.arange(8) < word[:, None])
        part = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + counts.sum(1) + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the one with each of these numbers, from 0, is."""
        block = np.searchsorted(self.before, k, "right") - 1
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        left = k - self.before[block]
        word = (upto <= left[:, None]).sum(1)
        left -= np.where(word > 0, upto[np.arange(len(k)), np.maximum(word, 1) - 1], 0)
        bits = np.unpackbits(self.words[block, word][:, None].view(np.uint8), axis=1, bitorder="little")
        return (block << 9) + (word << 6) + (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(1)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins and the last ends) of a binary array; nulls are empty."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def token_ends(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a token ends after each byte: before white space and at a text's end, as white space goes with what it precedes."""
    white = WHITE[data]
    out = np.ones(len(data), bool)
    out[:-1] = white[1:] & ~white[:-1]
    last = begin[1:][begin[1:] > begin[:-1]] - 1
    out[last] = True
    return out


def marked(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each text contains one of the three marks."""
    found = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & np.isin(data[1:-1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])) if len(data) > 2 else np.zeros(0, np.int64)
    owner = np.searchsorted(begin, found, "right") - 1
    out = np.zeros(len(begin) - 1, bool)
    out[owner[found + 3 <= begin[owner + 1]]] = True
    return out


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def transformed(ids: list, texts: pa.Array, rate: int, spm: int, seed: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of every text."""
    data, begin = buffer(texts)
    ends, chars = Bits(token_ends(data, begin)), Bits(data & 0xC0 != 0x80)
    first = ends.rank(begin)
    n = np.diff(first)
    h = draws(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(begin[:-1, None], 2, axis=1)
    at[cuts > 0] = ends.select((first[:-1, None] + cuts)[cuts > 0] - 1) + 1
    plain = (n == 0) | marked(data, begin) | (h[:, 2] % 100 >= rate)
    suffix_first = h[:, 3] % 100 < spm
    at = np.column_stack([begin[:-1], at, begin[1:]])
    counts = np.diff(chars.rank(at.ravel()).reshape(-1, 4), axis=1)
    raw, out = data.tobytes(), []
    for (a, b, c, d), whole, s in zip(at.tolist(), plain.tolist(), suffix_first.tolist()):
        if whole:
            out.append(raw[a:d])
        elif s:
            out.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
        else:
            out.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return [pa.array(n), pa.array(form.tolist(), pa.string()), *(pa.array(counts[:, k], mask=plain) for k in (0, 1)), pa.array(out, pa.binary())]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document, for training a model to fill in the middle.

    A text's n tokens (white space goes with the word that follows it; at the end it is a token of its own) are cut at two
    places drawn from a hash of seed and doc_id: prefix, middle, suffix. `rate` in 100 texts are transformed, `spm` in 100 of
    those with the suffix first: `<S>`suffix`<P>`prefix`<M>`middle; the others as `<P>`prefix`<S>`suffix`<M>`middle. The rest is
    plain: as it was, and the two sizes (in code points) are null. Null and empty texts are empty and plain, as are texts that
    contain a mark themselves, so that restored() is exact. A null doc_id is drawn for as an id without digits; repeated rows
    are all returned, with the same draws. White space is only ASCII's. A text of any length is cut as a whole. Other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(buffer(batch.column(1))[1])
            piece = np.cumsum(size) // PIECE_BYTES
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(piece)) + 1) if batch.num_rows else []:
                part = batch.slice(rows[0], len(rows))
                columns = transformed(part.column(0).to_pylist(), part.column(1), rate, spm, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", utf8("text").alias("t")).mapInArrow(run, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, rebuilt from its output and form alone."""

    def between(a: bytes, b: bytes) -> Column:
        return F.substring_index(F.substring_index(output, b.decode(), 1), a.decode(), -1)

    middle = F.substring_index(output, MIDDLE.decode(), -1)
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)
