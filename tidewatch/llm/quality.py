"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (A-Z lower-cased) and its words' shapes (runs of letters, capitals and
digits collapsed, other characters as they are), hashed to ``DIMS`` columns, and a few columns that
count repetition. Values are log(1 + count) times the inverse document frequency; words and shapes
are scaled to length 1 each, so that neither outweighs the other. A truncated singular value
decomposition of the labelled rows' matrix gives the latent space.

The labelled vectors are broadcast. Every document is multiplied with all of them, block by block; its
``NEIGHBOURS`` nearest by cosine vote for their label with the similarity raised to ``POWER``, times the
number of labelled rows that a vector stands for. The score is label 1's share of the votes.

At most ``MAX_TRAIN`` labelled rows of each label, chosen by the id's hash, are learned from: this bounds
the broadcast (2 * MAX_TRAIN * RANK * 4 bytes) and the driver's matrix; every document is scored whole.

Defined results: a null text counts as empty; a text without words has the zero vector, to which all
neighbours are equally near, and gets label 1's share of the labelled rows; rows with a null label or
null text are not learned from; both labels of a document are an example each, a repeated one is one
example; of rows that repeat a doc_id the text that sorts first is learned from; nothing to learn from:
0.5; one label only: that label's value; ties between neighbours: the first by id; other columns are
passed through, those named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tidewatch.llm.common import map_batches, require, slices, words_of
from tidewatch.session import ship

#: Labelled rows of each label to learn from, about.
MAX_TRAIN = 3_000
RANK, NEIGHBOURS, POWER = 64, 15, 4.0
#: Hashed columns of words, of shapes, and columns that count repetition.
WORD_DIMS, SHAPE_DIMS, REPEAT_DIMS = 3_072, 1_000, 24
DIMS = WORD_DIMS + SHAPE_DIMS + REPEAT_DIMS
#: Words whose columns a worker remembers: about 100 MB.
MEMORY_WORDS = 400_000
#: Documents that are multiplied at a time.
BLOCK = 1_024
SLICE = 1_000_000

_CLASS = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Columns(dict):
    """word -> (word column * 2**16 + shape column), computed on first sight."""

    def __missing__(self, word: bytes) -> int:
        kinds = word.translate(_CLASS)
        shape = _SHAPES.get(kinds)
        if shape is None:
            if len(_SHAPES) > MEMORY_WORDS // 4:
                _SHAPES.clear()
            shape = _SHAPES[kinds] = WORD_DIMS + xxh64_intdigest(_RUNS.sub(rb"\1", kinds), 7) % SHAPE_DIMS
        at = (xxh64_intdigest(word.lower(), 7) % WORD_DIMS << 16) + shape
        self[word] = at
        return at


_MEMORY = _Columns()
_SHAPES: dict[bytes, int] = {}


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns (ascending) and their counts of a whole text."""
    words = words_of(text.encode("utf-8", "surrogatepass")) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(_MEMORY) > MEMORY_WORDS:
        _MEMORY.clear()
    seen = Counter(words)
    at = np.fromiter(map(_MEMORY.__getitem__, seen), np.int64, len(seen))
    n = np.fromiter(seen.values(), np.float64, len(seen))
    total = np.bincount(at >> 16, n, DIMS) + np.bincount(at & 0xFFFF, n, DIMS)
    # Repetition: eight columns each for the share of repeated words, of words that follow themselves, and of the commonest word.
    base = WORD_DIMS + SHAPE_DIMS
    follow = sum(map(eq, words, words[1:]))
    for k, share in enumerate((1 - len(seen) / len(words), follow / len(words), float(n.max()) / len(words))):
        total[base + 8 * k + min(7, int(share * 8))] += 1
    cols = np.flatnonzero(total)
    return cols, total[cols]


def matrix(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Weighted dense rows of length 1 (zero if the text has no words); words, shapes and repetition weigh alike."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (cols, n) in enumerate(rows):
        x[i, cols] = np.log1p(n) * idf[cols]
    for lo, hi in ((0, WORD_DIMS), (WORD_DIMS, WORD_DIMS + SHAPE_DIMS), (WORD_DIMS + SHAPE_DIMS, DIMS)):
        norm = np.linalg.norm(x[:, lo:hi], axis=1, keepdims=True)
        x[:, lo:hi] /= np.where(norm > 0, norm, 1) * np.sqrt(3)
    return x


def latent_basis(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """(columns, rank): the leading right singular vectors of x, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


class Voters:
    """idf, basis (columns, rank), vectors (n, rank) of length 1, labels and weights (n), prior."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, rank: int, neighbours: int, power: float):
        self.labels, self.weights, self.neighbours, self.power = labels.astype(np.float64), weights, neighbours, power
        self.prior = float((self.labels * weights).sum() / weights.sum()) if len(rows) else 0.5
        seen = np.zeros(DIMS)
        for cols, _ in rows:
            seen[cols] += 1
        self.idf = (np.log((1 + len(rows)) / (1 + seen)) + 0.1).astype(np.float32)
        x = matrix(rows, self.idf)
        self.basis = latent_basis(x, rank) if len(rows) else np.zeros((DIMS, 1), np.float32)
        self.vectors = self._project(x)

    def _project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.basis
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(norm > 0, norm, 1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(rows) if k else 0, BLOCK):
            part = rows[lo : lo + BLOCK]
            cosine = self._project(matrix(part, self.idf)) @ self.vectors.T
            edge = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k]
            for i, row in enumerate(cosine):
                if len(part[i][0]):
                    near = np.flatnonzero(row >= edge[i])
                    if len(near) > k:  # ties at the edge: the first by id
                        near = near[np.argsort(-row[near], kind="stable")[:k]]
                    vote = np.maximum(row[near].astype(np.float64), 1e-6) ** self.power * self.weights[near]
                    out[lo + i] = float((vote * self.labels[near]).sum() / vote.sum())
        return np.clip(out, 0.0, 1.0)


def fit(df: DataFrame, labels: DataFrame, *, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER) -> Voters:
    """Learn from the rows of ``df`` that ``labels`` (id_col, label_col) marks 0 or 1. ``train``: a condition on labels' rows."""
    require(df, id_col, text_col)
    require(labels, id_col, label_col)
    ship(df.sparkSession)
    marked = (labels.where(train) if train is not None else labels).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.distinct()
    per = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not per:
        return Voters([], np.zeros(0), np.zeros(0), rank, neighbours, power)
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    limit = F.create_map(*[F.lit(v) for k, n in per.items() for v in (k, min(1.0, max_train / n))])
    chosen = marked.where(share < F.element_at(limit, F.col("label")))
    # About 2 * max_train rows of two numbers: their ids may be broadcast. One row for each is left, whatever repeats.
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.float64()))], names=["id", "label", "cols", "n"])

    got = rows.select("id", "text", "label").mapInArrow(run, "id string, label int, cols array<long>, n array<double>")
    got = sorted(got.toArrow().to_pylist(), key=lambda r: (r["id"], r["label"], r["cols"], r["n"]))  # at most DIMS numbers a row
    y = np.array([r["label"] for r in got], np.float64)
    weight = {k: n / max(1, int((y == k).sum())) for k, n in per.items()}
    return Voters([(np.array(r["cols"], np.int64), np.array(r["n"])) for r in got], y, np.array([weight[int(v)] for v in y]), rank, neighbours, power)


def score(df: DataFrame, model: Voters, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with score double and predicted int after its columns."""
    require(df, text_col)
    spark = df.sparkSession
    ship(spark)
    df = df.drop("score", "predicted")
    at = df.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_TRAIN, RANK and DIMS: about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [shared.value.scores([counts(t) for t in texts[lo:hi]]) for lo, hi in slices(texts, SLICE)]
            if found:
                s = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return map_batches(df, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
