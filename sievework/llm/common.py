"""Helpers that several operators share: reading, words, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.shared import in_buckets, materialise, release, shared_folder, unused  # noqa: F401  for the operators here

#: A word, as every contract here counts it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: str) -> Column:
    """The column's text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


def held_out(column: str = "doc_id") -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.crc32(F.col(column).cast("string")) % 4 == 2


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """These session settings for what runs meanwhile."""
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of the runs with these sizes starts."""
    out = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=out[1:])
    return out


def ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin[i] .. begin[i]+size[i]-1 for every i, one after another, and the i of each."""
    owner = np.repeat(np.arange(len(begin)), size)
    return np.arange(len(owner)) - np.repeat(starts(size), size) + begin[owner], owner
