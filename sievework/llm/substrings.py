"""Substring dedup of word windows behind a count-min prefilter (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.repeats import Kind, covered, repeated, rewritten, span_arrays

WINDOW = 35
#: A word and the white space after it.
_SPACED = regex.compile(rb"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*")


def window_kind(window: int) -> Kind:
    return Kind(True, window, max(1, window // 4), 5.0)


def cut(text: bytes, out: np.ndarray) -> bytes:
    """text without the words that out marks and the white space after them."""
    return b"".join(w for w, gone in zip(_SPACED.findall(text), out.tolist()) if not gone)


def drop_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words cut out of `text` that substring_dedup() removes, and n_chars set anew; all columns are returned.

    No row goes: a text of which nothing is left comes back empty, a null one null. Rows that are repeated repeat each other's
    windows, so that all of them lose those. Columns of any name are kept; an empty table gives no rows.
    """
    out = rewritten(docs, window_kind(window), False, lambda text, spans: cut(text, covered(spans, len(text.split()), window)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word that a `window`-word sequence covers which also starts anywhere else, in any document.

    Windows are judged on the input. Returns doc_id, n_words, n_removed, text (what is left; white space between kept words
    stays as it was) and kept_sha256 (of the kept words joined by one space). A null, empty or blank text has no words; it
    comes back with zero counts and an empty text. Rows with equal doc_id each come back; a null doc_id takes part like any
    other. Other columns of docs, whatever their names, are ignored.
    """

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, gone, texts, shas = [], [], [], []
        for text, spans in zip(batch.column(1), span_arrays(batch.column(2))):
            text = text.as_py() or b""
            words = text.split()
            out = covered(spans, len(words), window)
            if out.any():
                keep = (~out).tolist()
                kept = [w for w, k in zip(words, keep) if k]
                text = cut(text, out)
            else:
                kept = words
            counts.append(len(words))
            gone.append(int(out.sum()))
            texts.append(text.decode())
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.string())],
            ["doc_id", "n_words", "n_removed", "text", "kept_sha256"],
        )

    return repeated(docs, window_kind(window), False, finish, "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
