"""Embedding near-duplicates by quantised tiles with rigorous error bounds.

Identical vectors are collapsed first. The distinct ones are scaled to length 1 in double precision and
dealt to blocks of bounded size; each pair of blocks is a tile. A tile multiplies the vectors' int8
quantisations (held as float32, in which their products and sums are exact integers). With e the length
of a vector's quantisation error, measured for each vector, the true cosine differs from the quantised
one by at most e_u + (1 + e_u) * e_v; only pairs that could reach the threshold are computed again in
double precision. A tile returns for each vector its number of links there and one edge to the smallest
member of its component there, so never all pairs; degrees are summed, and the edges are joined by
distributed connected components.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing and is its own component; vectors of different lengths do not link; identical vectors link with
each other; of rows that repeat a vec_id each counts as a vector; a null vec_id never names a component;
a component of null ids alone has none; labels and extra columns play no part; no rows give no rows.
A cosine within rounding of the threshold is always summed in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_with_heavy, require
from tidewatch.llm.components import connected_components, merge
from tidewatch.session import cut, ship

THRESHOLD = 0.9
#: Vectors of a block: at least, at most, and the number of blocks aimed at between the two.
BLOCK_MIN, BLOCK_MAX, BLOCKS = 4_096, 16_384, 32
#: Bytes of a block's vectors at most (a single longer vector is a block): a tile holds two blocks and a few copies of them.
BLOCK_BYTES = 64_000_000
#: Vectors of a tile that are multiplied at a time.
ROWS = 512
#: More than rounding can add to a cosine in double precision.
SLACK = 1e-9
#: Lengths of vectors up to which their table is broadcast (under 1 MB); beyond it the join is salted.
BROADCAST_DIMS, SALTS = 10_000, 64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, robust against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 codes, the scale of each row, and a bound of each row's error length."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    e = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-14
    return q, scale, e


def tile_links(a: np.ndarray, b: np.ndarray | None, weight: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a (and b); weight: copies of each row of a, then b -> (links, label) of each row.

    links: the copies of other rows in the tile that it links with (within a where b is None).
    """
    other = a if b is None else b
    off = 0 if b is None else len(a)
    links, label = np.zeros(len(weight), np.int64), np.arange(len(weight))
    qa, sa, ea = quantise(a)
    qb, sb, eb = (qa, sa, ea) if b is None else quantise(b)
    exact = a.shape[1] * 127 * 127 < 1 << 24  # sums that float32 holds exactly
    kind = np.float32 if exact else np.float64
    qb_t = qb.astype(kind).T.copy()
    for i in range(0, len(a), ROWS):
        rows = np.arange(i, min(i + ROWS, len(a)))
        about = (qa[rows].astype(kind) @ qb_t).astype(np.float64)
        about *= sa[rows, None]
        about *= sb[None, :]
        may = about + (ea[rows, None] + (1 + ea[rows, None]) * eb[None, :]) >= threshold - SLACK
        if b is None:
            may[np.arange(len(rows)), rows] = False
        r, c = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if not len(r):
            continue
        if len(r) * len(c) <= 8 * np.count_nonzero(may):
            exactly = a[rows[r]] @ other[c].T
            x, y = np.nonzero((np.abs(exactly - threshold) < SLACK) & may[np.ix_(r, c)])
            for k in range(0, len(x), 100_000):
                x_k, y_k = x[k : k + 100_000], y[k : k + 100_000]
                exactly[x_k, y_k] = np.einsum("ij,ij->i", a[rows[r[x_k]]], other[c[y_k]])
            sure = (exactly >= threshold) & may[np.ix_(r, c)]
        else:
            sure = np.zeros((len(r), len(c)), bool)
            x, y = np.nonzero(may[np.ix_(r, c)])
            for k in range(0, len(x), 100_000):
                x_k, y_k = x[k : k + 100_000], y[k : k + 100_000]
                sure[x_k, y_k] = np.einsum("ij,ij->i", a[rows[r[x_k]]], other[c[y_k]]) >= threshold
        links[rows[r]] += sure @ weight[c + off]
        if b is not None:
            links[c + off] += weight[rows[r]] @ sure
        for k in np.flatnonzero(sure.any(axis=1)):
            label = merge(label, rows[r[k]], c[sure[k]] + off)
    return links, label


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, dim int, key binary, vec binary): dim 0 where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 10_000):
                dims, keys, vecs = [], [], []
                for x in lists.slice(lo, 10_000):
                    v = np.array([], float) if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                    raw = (v + 0.0).tobytes() if good else b""
                    dims.append(len(v) if good else 0)
                    keys.append(hashlib.sha256(raw).digest()[:16] if good else None)
                    vecs.append(raw)
                n = len(dims)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "dim", "key", "vec"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, "vec_id long, dim int, key binary, vec binary")


def near_links(distinct: DataFrame, *, threshold: float = THRESHOLD, block_min: int = BLOCK_MIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """distinct (key, dim, vec, rep, n) -> (u, v, links): for each tile in which rep u links, its links there and the tile's smallest connected rep v.

    The reps are different longs.
    """
    fitting = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.col("dim"))))
    size = F.least(F.lit(BLOCK_MAX), fitting, F.greatest(F.lit(block_min), F.floor(F.col("vectors") / BLOCKS)))
    sizes = cut(distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("vectors")).select("dim", F.greatest(F.lit(1), F.ceil(F.col("vectors") / size)).cast("int").alias("parts")))
    if sizes.count() <= BROADCAST_DIMS:
        met = distinct.join(F.broadcast(sizes), "dim")
    else:
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = distinct.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["dim", "salt"]).drop("salt")
    packed = met.withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    packed = packed.groupBy("dim", "block").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("rep", "n", "vec")).alias("of"))
    packed = packed.select("dim", "block", "parts", "of.rep", "of.n", "of.vec")
    dealt = packed.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", F.least("block", "peer").alias("a"), F.greatest("block", "peer").alias("b"), "block", "rep", "n", "vec")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        if len(pdf) == 1 and pdf["a"].iloc[0] != pdf["b"].iloc[0]:  # the other block is empty
            return pd.DataFrame({"u": [], "v": [], "links": []}, dtype=np.int64)
        sides = [unit(np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1)) for v in pdf["vec"]]
        rep = np.concatenate([np.asarray(x, np.int64) for x in pdf["rep"]])
        links, label = tile_links(sides[0], sides[1] if len(sides) > 1 else None, np.concatenate([np.asarray(x, np.int64) for x in pdf["n"]]), threshold)
        to = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(to, label, rep)
        some = links > 0
        return pd.DataFrame({"u": rep[some], "v": to[label][some], "links": links[some]})

    return dealt.groupBy("dim", "a", "b").applyInPandas(compare, "u long, v long, links long")


def embedding_dedup(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, block_min: int = BLOCK_MIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    require(df, id_col, vec_col)
    ship(df.sparkSession)
    rows = cut(_rows(df, id_col, vec_col))
    solid = rows.where("dim > 0")
    distinct = solid.groupBy("key").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    # Vectors are compared by numbers of their own: ids may be null, and then link others all the same.
    distinct = cut(distinct.withColumn("rep", F.monotonically_increasing_id()))
    tiles = cut(near_links(distinct, threshold=threshold, block_min=block_min, block_bytes=block_bytes))
    links = tiles.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    groups = connected_components(tiles.select("u", "v")).withColumnRenamed("node", "rep")
    found = cut(distinct.select("key", "rep", "vec_id", "n").join(links, "rep", "left").join(groups, "rep", "left").withColumn("group", F.coalesce("component_id", "rep")).drop("component_id"))
    names = found.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    named = cut(found.join(names, "group").select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    linked = join_with_heavy(rows.where("dim > 0").select("vec_id", "key"), named, "key", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
