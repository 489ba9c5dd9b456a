"""SimHash near-duplicates: exact comparison of all distinct fingerprints, tile by tile.

Fingerprints come from 3-word shingles (whole texts). Equal fingerprints are collapsed first, so copies
cost nothing. The distinct ones are dealt to blocks of one population count each; two fingerprints
within the radius have population counts within the radius, so only such block pairs (tiles) are
compared, with numpy exclusive-or and bit counts. Inside a tile the same bound is applied to the counts
of the high halves. A tile returns a spanning forest of its links, never all pairs, and the forests are
joined by distributed connected components.

Within 3 bits are about a third of the pairs of texts whose 5-word shingles are 0.8 or more alike (README).

Defined results: a null or wordless text has fingerprint zero, which links like any other; a text of
fewer than three words has one shingle, all its words; rows that repeat a doc_id get the same
component; a null doc_id links like any other but never names a component, so one of null ids alone has
none; extra columns play no part; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, join_with_heavy, require, words_of
from tidewatch.llm.components import connected_components, merge
from tidewatch.session import cut, ship

#: Words of a shingle, the hash seed and the link radius: fixed by the contract of the query.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a block at least and at most, and the number of blocks aimed at between the two.
BLOCK_MIN, BLOCK_MAX, BLOCKS = 8_192, 262_144, 128

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    words = words_of(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
    by_byte = h.view(np.uint8).reshape(-1, 8)
    out = 0
    for j in range(8):
        ones = np.bincount(by_byte[:, j], minlength=256) @ _BITS
        out |= int(np.packbits(ones * 2 > len(h), bitorder="little")[0]) << (8 * j)
    return out


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits, of shingles of so many words, as a signed long."""
    require(df, id_col, text_col)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fp = np.fromiter((fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- tiles ----------------------------------------------------------------------------------------


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Component labels over a (and b) of the links between a and b, or within a where b is None.

    a, b: uint64. The label of a position is the smallest position of its component in a followed by b.
    """
    both = a if b is None else np.concatenate([a, b])
    off = 0 if b is None else len(a)
    other = a if b is None else b
    label = np.arange(len(both))
    high = np.bitwise_count(other >> np.uint64(32)).astype(np.int64)
    order = np.argsort(high, kind="stable")
    other, high = other[order], high[order]
    a_high = np.bitwise_count(a >> np.uint64(32)).astype(np.int64)
    a_order = np.argsort(a_high, kind="stable")
    diff = int(np.bitwise_count(other[0])) - int(np.bitwise_count(a[0])) if len(other) and len(a) else 0
    # |dh| + |diff - dh| <= radius bounds dh, the difference of the high halves' counts.
    lo, hi = (diff - radius) / 2, (diff + radius) / 2
    step = max(1, 262_144 // max(1, len(other)))
    for i in range(0, len(a), step):
        rows = a_order[i : i + step]
        s = np.searchsorted(high, a_high[rows[0]] + lo, "left")
        e = np.searchsorted(high, a_high[rows[-1]] + hi, "right")
        if s >= e:
            continue
        near = np.bitwise_count(a[rows][:, None] ^ other[None, s:e]) <= radius
        for r in np.flatnonzero(near.any(axis=1)):
            cols = order[s:e][near[r]] + off
            label = merge(label, rows[r], cols)
    return label


def near_edges(distinct: DataFrame, *, radius: int = RADIUS, block_min: int = BLOCK_MIN) -> DataFrame:
    """distinct (fp, rep), one row for each fingerprint, reps different longs -> (u, v): a spanning forest of the links, tile by tile, between reps."""
    spark = distinct.sparkSession
    ship(spark)
    counted = distinct.withColumn("ones", F.bit_count("fp").cast("int"))
    per = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    size = min(BLOCK_MAX, max(block_min, sum(per.values()) // BLOCKS))
    first, parts, ends = [], [], []
    for ones in range(65):
        first.append(ends[-1] if ends else 0)
        parts.append(-(-per.get(ones, 0) // size))
        ends.append(first[-1] + parts[-1])
    if not per:
        return spark.createDataFrame([], "u long, v long")

    def pick(values: list[int], at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)

    ones = F.col("ones")
    block = pick(first, ones) + F.pmod(F.xxhash64("fp"), F.greatest(pick(parts, ones), F.lit(1))).cast("int")
    packed = counted.withColumn("block", block).groupBy("block").agg(F.first("ones").alias("ones"), F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
    # A block meets the blocks whose count is at most the radius away: a range of block numbers.
    low = pick([first[max(0, p - radius)] for p in range(65)], ones)
    high = pick([ends[min(64, p + radius)] - 1 for p in range(65)], ones)
    dealt = packed.withColumn("peer", F.explode(F.sequence(low, high))).select(F.least("block", "peer").alias("a"), F.greatest("block", "peer").alias("b"), "block", "fps", "reps")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        fps = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["fps"]]
        reps = np.concatenate([np.asarray(x, np.int64) for x in pdf["reps"]])
        if len(fps) == 1 and pdf["a"].iloc[0] != pdf["b"].iloc[0]:  # the other block does not exist
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        label = tile_forest(fps[0], fps[1] if len(fps) > 1 else None, radius)
        to = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(to, label, reps)
        to = to[label]
        return pd.DataFrame({"u": reps[to != reps], "v": to[to != reps]})

    return dealt.groupBy("a", "b").applyInPandas(compare, "u long, v long")


def simhash_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block_min: int = BLOCK_MIN) -> DataFrame:
    """(doc_id, fp long, fingerprint hex, component_id): component_id is the smallest doc_id reachable by links."""
    fps = cut(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    # Fingerprints stand for themselves: ids may be null, and then link others all the same.
    groups = connected_components(near_edges(distinct.select("fp", F.col("fp").alias("rep")), radius=radius, block_min=block_min)).select(F.col("node").alias("fp"), F.col("component_id").alias("group"))
    found = cut(distinct.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    names = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = cut(found.join(names, "group").select("fp", "n", "component_id"))
    return join_with_heavy(fps, named, "fp", "n").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``df`` with one document of each group: the one whose id names it. Columns are unchanged.

    Of rows that repeat that id, all stay; rows with a null id stay.
    """
    loser = fresh(df, "loser")[0]
    losers = simhash_groups(df, id_col=id_col, text_col=text_col, **kw).where("doc_id <> component_id").select(F.col("doc_id").alias(loser)).distinct()
    return df.join(losers, F.col(f"`{id_col}`") == F.col(loser), "left_anti")
