"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word pattern of the query contracts: maximal runs without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() splits at exactly x20 and x09-x0D."""
    return text.split()


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, one row at least: bounds the scratch memory of a batch."""
    lo, size = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def slices(texts: list, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``max_bytes`` characters each."""
    return spans([len(t) if t else 0 for t in texts], max_bytes)


class Memory:
    """A bounded dictionary of two generations: a full one becomes the old one, and what is met again moves on."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that neither generation has; those of the old one are taken over."""
        if len(self.now) > self.size:
            self.old, self.now = self.now, {}
        new = keys.difference(self.now)
        known = new.intersection(self.old) if self.old else ()
        if known:
            old = self.old
            self.now.update([(k, old[k]) for k in known])
            new.difference_update(known)
        return new


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: list[T.StructField]) -> DataFrame:
    """mapInArrow over the columns of ``df``, which come first in what ``run`` yields, whatever their names."""
    names = [f"c{k}" for k in range(len(df.columns))]
    kinds = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, df.schema.fields, strict=True)]
    extra = [T.StructField(f"x{k}", f.dataType, f.nullable) for k, f in enumerate(added)]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=[f.name for f in (*kinds, *extra)])

    return df.toDF(*names).mapInArrow(renamed, T.StructType([*kinds, *extra])).toDF(*df.columns, *(f.name for f in added))


#: Keys that may be joined apart from the others: those with over a 1 / HEAVY_KEYS share of all rows, so fewer than this.
HEAVY_KEYS = 1_000


def join_with_heavy(left: DataFrame, right: DataFrame, key: str, rows_col: str) -> DataFrame:
    """The inner join on ``key``, for which ``right`` has one row with the number of ``left``'s rows in ``rows_col``.

    Rows of a key that many rows have stay where they are and meet a broadcast table of fewer than ``HEAVY_KEYS`` rows.
    """
    total = right.agg(F.sum(rows_col)).first()[0] or 0
    heavy = F.broadcast(right.where(F.col(rows_col) * HEAVY_KEYS > total))
    light = left.join(heavy.select(key), key, "left_anti").join(right, key)
    return left.join(heavy, key).unionByName(light)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, ignoring case: the given ones, with underscores added where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
