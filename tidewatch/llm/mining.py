"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

Components x become the integers floor(256 x), so inner products are exact. A vector v gets one more
coordinate, sqrt(M^2 - |v|^2) with M the greatest length of its block, and an anchor q gets 0: then
|q - v|^2 = |q|^2 + M^2 - 2 q.v, a higher score is a smaller distance, and a window of scores is an annulus around
the anchor. Rows are dealt to blocks of bounded size. Each block has a vantage-point tree: a node is split at
the median distance from its vantage point, and remembers the ring each half lies in. A search goes through
the nodes nearest first, from a heap; the triangle inequality bounds their distances, so nodes outside the
annulus, or without a row of the wanted labels, are never opened, and it ends with the k-th row that is nearer
than all nodes left. Every block answers for every anchor, and what blocks found is merged.

Two passes: the positives (the first ``positives`` other rows of the anchor's label), then for each of their
scores the first ``negatives`` rows of other labels in [ratio x score, score].

Defined results: rows with a null label, a null vector, a null or non-finite component, or a vector too long for
scores in a long take no part; rows that agree in id, label and integers are one row, others that repeat an id
are rows of their own; a null id is no anchor and comes last in ties; rows meet rows with as many components
only (an empty vector scores 0 with empty ones); ties beyond the id follow a digest of the row; anchors without
positives, or positives without negatives, give no rows; extra columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import require
from tidewatch.session import cut, ship

#: Rows of a block: at least, at most, and the number of blocks aimed at between the two. Bytes of a block's vectors at most.
BLOCK_MIN, BLOCK_MAX, BLOCKS, BLOCK_BYTES = 1_024, 16_384, 32, 64_000_000
#: Rows of a leaf: few enough for rings to matter, enough for one product to pay.
LEAF = 256


class VantageTree:
    """Rows (integer vectors, labels, ids with None last in ties, digests) of one block."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: list, keys: list, leaf: int = LEAF):
        self.x, self.labels, self.ids, self.keys = x, labels, ids, keys
        f = x.astype(np.float64)
        own = (f * f).sum(axis=1)
        self.m2 = float(own.max(initial=0.0))
        self.small = self.m2 < 2**50  # products of such rows are exact in double precision
        self.f = np.column_stack([f, np.sqrt(np.maximum(self.m2 - own, 0.0))])
        self.order = np.arange(len(x))
        #: start, end, vantage row or -1, left, right, near, far (ring around the parent's vantage point), least and greatest label
        self.nodes: list[list] = []
        stack = [(0, len(x), -1, 0, 0.0, np.inf)]
        while stack:
            lo, hi, parent, side, near, far = stack.pop()
            rows = self.order[lo:hi]
            at = len(self.nodes)
            self.nodes.append([lo, hi, -1, -1, -1, near, far, labels[rows].min(initial=2**62), labels[rows].max(initial=-(2**62))])
            if parent >= 0:
                self.nodes[parent][3 + side] = at
            if hi - lo <= leaf:
                continue
            away = self._from(self.f[rows[0]], rows)
            vantage = int(rows[np.argmax(away)])
            away = self._from(self.f[vantage], rows)
            sort = np.argsort(away, kind="stable")
            self.order[lo:hi], away = rows[sort], away[sort]
            mid = (hi - lo) // 2
            self.nodes[at][2] = vantage
            stack.append((lo, lo + mid, at, 0, away[0], away[mid - 1]))
            stack.append((lo + mid, hi, at, 1, away[mid], away[-1]))
        self.vantages = np.array([n[2] for n in self.nodes if n[2] >= 0], int)
        self.slot = {int(v): k for k, v in enumerate(self.vantages)}
        self.labelled = labels[self.order]  # in the tree's order, as the vectors from here on: a leaf is a slice
        self.at_vantages = self.f[self.vantages, :-1]
        self.f, self.x = np.ascontiguousarray(self.f[self.order, :-1]), x[self.order]

    def _from(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = self.f[rows] - point
        return np.sqrt((d * d).sum(axis=1))

    def ask(self, q: np.ndarray) -> Asked:
        return Asked(self, q)


class Asked:
    """An anchor before a tree: its distances from the vantage points, and the scores of leaves opened so far."""

    def __init__(self, tree: VantageTree, q: np.ndarray):
        self.tree, self.q, self.qf = tree, q, q.astype(np.float64)
        q2 = float(self.qf @ self.qf)
        self.small = tree.small and q2 < 2**50
        self.total = q2 + tree.m2
        self.slack = 1e-12 * self.total + 1.0  # of scores: more than rounding can add
        self.loose = math.sqrt(1e-12 * self.total)  # of distances
        self.to = np.sqrt(np.maximum(self.total - 2 * (tree.at_vantages @ self.qf), 0.0)).tolist()
        self.opened: dict[int, np.ndarray] = {}

    def scores(self, leaf: int, lo: int, hi: int) -> np.ndarray:
        """Exact inner products with a leaf's rows."""
        found = self.opened.get(leaf)
        if found is None:
            found = self.opened[leaf] = self.tree.f[lo:hi] @ self.qf if self.small else self.tree.x[lo:hi] @ self.q
        return found

    def first(self, label: int, same: bool, low: int | None, high: int | None, k: int, own: bytes | None = None) -> list[tuple[int, int]]:
        """(score, row) of the k first rows of the label (``same``) or of others with low <= score <= high, the row ``own`` left out."""
        tree, total, slack, loose = self.tree, self.total, self.slack, self.loose
        heap: list[tuple] = [(-math.inf, 0, 0, 0.0, math.inf)]
        out: list[tuple[int, int]] = []
        while heap and len(out) < k:
            top = heapq.heappop(heap)
            if top[1]:
                out.append((int(-top[0]), top[-1]))
                continue
            at, least, most = top[2:]
            lo, hi, vantage, left, right, _, _, a, b = tree.nodes[at]
            if lo == hi or ((label < a or label > b) if same else (a == b == label)):
                continue
            if vantage >= 0:
                d = self.to[tree.slot[vantage]]
                for child in (left, right):
                    near, far = tree.nodes[child][5:7]
                    c_least = max(least, d - far - loose, near - d - loose)
                    c_most = min(most, d + far + loose)
                    best = (total - c_least * c_least) / 2 + slack  # no score of the child is above
                    if low is not None and best < low:
                        continue
                    if high is not None and (total - c_most * c_most) / 2 - slack > high:
                        continue
                    heapq.heappush(heap, (-best, 0, child, c_least, c_most))
                continue
            s = self.scores(at, lo, hi)
            ok = (tree.labelled[lo:hi] == label) if same else (tree.labelled[lo:hi] != label)
            if low is not None:
                ok &= s >= low
            if high is not None:
                ok &= s <= high
            places = np.flatnonzero(ok)
            if len(places) > 4 * k:  # rows below the k-th score of a leaf cannot be among the first k
                found = s[places]
                places = places[found >= np.partition(found, len(found) - k - 1)[len(found) - k - 1]]
            for p in places.tolist():
                r = int(tree.order[lo + p])
                if own is None or tree.keys[r] != own:
                    heapq.heappush(heap, (-s[p].item(), 1, tree.ids[r] is None, tree.ids[r] or 0, tree.keys[r], r))
        return out


def prepare(df: DataFrame, *, id_col: str, label: Column, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, label, v, key): the distinct rows that take part, v as integers; key tells rows apart."""
    e = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), e.alias("e")).where(F.col("label").isNotNull() & F.col("e").isNotNull()).where(finite)
    rows = rows.where(F.aggregate("e", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)) < float(2**61))
    rows = rows.select("id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))
    key = F.unhex(F.md5(F.concat_ws(" ", F.col("id").cast("string"), F.col("label").cast("string"), F.array_join("v", ",")).cast("binary")))
    return rows.distinct().withColumn("key", key)


def _tiles(anchors: DataFrame, rows: DataFrame, schema: str, run) -> DataFrame:
    """Every block of rows with every block of anchors of the same size of vectors: run(anchor batch, tree) yields result rows."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("components")).first()
    per = max(1.0, min(BLOCK_MAX, BLOCK_BYTES * size["n"] / (8.0 * max(1, size["components"] or 0))))  # rows of a block by their mean size
    row_blocks = max(1, math.ceil(size["n"] / per), min(BLOCKS, math.ceil(size["n"] / BLOCK_MIN)))
    anchor_blocks = max(1, math.ceil(anchors.count() / per))
    dealt, dim = F.xxhash64("key"), F.size("v").alias("dim")
    every = {n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")) for n in (row_blocks, anchor_blocks)}
    left = rows.select(dim, F.pmod(dealt, F.lit(row_blocks)).alias("b"), every[anchor_blocks].alias("a"), "id", "label", "v", "key")
    right = anchors.select(dim, every[row_blocks].alias("b"), F.pmod(dealt, F.lit(anchor_blocks)).alias("a"), *anchors.columns)

    def tile(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if len(rows) and len(asked):
            dim = rows["dim"][0].as_py()
            x = _matrix(rows["v"], len(rows), dim)
            tree = VantageTree(x, rows["label"].to_numpy(), rows["id"].to_pylist(), rows["key"].to_pylist())
            q = _matrix(asked["v"], len(asked), dim)
            rest = {c: asked[c].to_pylist() for c in asked.column_names if c != "v"}
            for values in run(tree, q, rest):
                for column, v in zip(out, values, strict=True):
                    column.append(v)
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=names)

    kinds = [{"long": pa.int64(), "binary": pa.binary()}[f.strip().split(" ")[1]] for f in schema.split(",")]
    ship(rows.sparkSession)
    right = right.toDF(*right.columns)  # columns of their own, as both sides come from the same rows
    return left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInArrow(tile, schema)


def _matrix(v: pa.ChunkedArray, n: int, dim: int) -> np.ndarray:
    return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k first rows of each group by score, then id, then digest, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100), scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition on the column ``id``. ratio: least score of a negative as a fraction of the positive's.
    """
    require(df, id_col, vector_col)
    rows = cut(prepare(df, id_col=id_col, label=F.col("label") if label is None else label, vector_col=vector_col, scale=scale))
    anchors = rows.where(is_anchor).select("v", F.col("label").alias("anchor_label"), F.col("key").alias("anchor_key"), F.col("key"), F.col("id").alias("anchor_id"))

    def find_positives(tree: VantageTree, q: np.ndarray, rest: dict) -> Iterator[tuple]:
        for i in range(len(q)):
            for s, r in tree.ask(q[i]).first(rest["anchor_label"][i], True, None, None, positives, rest["anchor_key"][i]):
                yield rest["anchor_key"][i], rest["anchor_id"][i], s, tree.ids[r], tree.keys[r]

    found = _tiles(anchors, rows, "anchor_key binary, anchor_id long, score long, id long, key binary", find_positives)
    chosen = cut(_first(found, ["anchor_key"], positives).select("anchor_key", "anchor_id", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), F.col("rank").alias("position")))

    windows = chosen.where("positive_score >= 0").groupBy("anchor_key").agg(F.collect_set("positive_score").alias("wanted"))  # at most ``positives``
    wanted = anchors.join(windows, "anchor_key")
    part, whole = ratio

    def find_negatives(tree: VantageTree, q: np.ndarray, rest: dict) -> Iterator[tuple]:
        for i in range(len(q)):
            for p in rest["wanted"][i]:
                for s, r in tree.ask(q[i]).first(rest["anchor_label"][i], False, -((-part * p) // whole), p, negatives):
                    yield rest["anchor_key"][i], p, s, tree.ids[r], tree.keys[r]

    found = _tiles(wanted, rows, "anchor_key binary, positive_score long, score long, id long, key binary", find_negatives)
    best = _first(found, ["anchor_key", "positive_score"], negatives).select("anchor_key", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(best, ["anchor_key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
