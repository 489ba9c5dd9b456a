"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of positions holds a bit for each language, so one look at an n-gram's positions returns the
mask of all languages whose filter contains it (the bitwise and over its positions). For each text the
hits of each language are counted and corrected for that language's false positive rate,
(hits / n - f) / (1 - f); the largest estimate decides, and it is the score: the estimated share of the
text's n-grams that belong to the language.

Training: n-grams (3 and 4 letters with word boundaries, lower case) of a sample of labelled rows, at most about
``max_docs`` a language, chosen by hash. A language's filter takes the n-grams with a share of at
least ``min_share`` of its n-grams (so 1 / min_share of them at most: the size of the table is
proven), seen ``min_count`` times, and no rarer than ``rel`` times their share in any other language,
which keeps out foreign quotations.

Defined results: text null or without a letter: ``und``, score 0; no estimate above 0: the first
language by code point, score 0; ties: the first by code point; nothing to learn from: ``und``, score 0;
rows with null lang are never learned from; other columns are passed through, those named like the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import map_batches, mix64, require, slices
from tidewatch.session import ship

#: Rows of a language to learn from, about.
MAX_DOCS = 4_000
MIN_SHARE, MIN_COUNT, REL = 2e-5, 3, 0.2
SIZES = (3, 4)
#: Positions of the table (a power of two, 2**20 at most) and positions of an n-gram.
POSITIONS, HASHES = 1 << 19, 3
#: Rejected below this share.
MIN_SCORE = 0.35
#: Characters that are scratch at a time.
SLICE = 1_000_000

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the hashes of the texts' n-grams, and where each text's begin and end (len(texts) + 1 offsets)."""
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = 1 + np.cumsum([len(t) + 1 for t in low])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one blank after each word
    at = np.concatenate([[0], np.cumsum(keep)])
    x = np.where(letter, codes, 32)[keep].astype(np.uint64)
    solid = letter[keep]
    # A text's first n-gram starts at the blank before it.
    bounds = at[np.concatenate([[1], ends])] - 1
    for n in SIZES:
        m = max(0, len(x) - n + 1)
        h = np.full(m, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        ok = np.ones(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ x[j : j + m]
            if 0 < j < n - 1:
                ok &= solid[j : j + m]
        total = np.concatenate([[0], np.cumsum(ok)])
        yield mix64(h[ok]), total[np.clip(bounds, 0, m)]


def _sample(df: DataFrame, max_docs: int, id_col: str, lang_col: str) -> DataFrame:
    """Rows of each language whose id's hash lies below max_docs / its rows."""
    per = df.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each label
    if not per:
        return df.limit(0)
    limit = F.create_map(*[F.lit(v) for r in per for v in (r[lang_col], min(1.0, max_docs / r["n"]))])
    share = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    return df.where(share < F.element_at(limit, F.col(lang_col)))


class LanguageFilters:
    """langs in code point order; tables: one array of masks for each 64 languages; rates: false positive rate of each language."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams, key=lambda s: s.encode("utf-8", "surrogatepass"))
        self.tables, self.rates = [], np.zeros(len(self.langs))
        for lo in range(0, len(self.langs), 64):
            group = self.langs[lo : lo + 64]
            kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(group) <= bits)
            t = np.zeros(POSITIONS, kind)
            for i, lang in enumerate(group):
                bit = np.zeros(POSITIONS, bool)
                for at in self._positions(grams[lang]):
                    bit[at] = True
                t |= bit.astype(kind) << kind(i)
                self.rates[lo + i] = bit.mean() ** HASHES
            self.tables.append(t)

    @staticmethod
    def _positions(h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(21 * k)) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(HASHES)]

    def estimates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares, and the number of n-grams of each text."""
        hits, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, bounds in ngrams(texts):
            n += np.diff(bounds)
            places = self._positions(h)
            for k, t in enumerate(self.tables):
                mask = t[places[0]]
                for p in places[1:]:
                    mask &= t[p]
                for i in range(min(64, len(self.langs) - 64 * k)):
                    upto = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i)) & mask.dtype.type(1), dtype=np.int64)])
                    hits[:, 64 * k + i] += np.diff(upto[bounds])
        share = hits / np.maximum(n, 1)[:, None]
        return np.clip((share - self.rates) / (1 - self.rates), 0, 1), n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        est, n = self.estimates(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), n
        best = est.argmax(axis=1)
        score = np.where(n > 0, est[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if m else "und" for b, m in zip(best, n, strict=True)], score, n


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, min_count: int = MIN_COUNT, rel: float = REL) -> LanguageFilters:
    """Learn from the rows of ``df`` with text and lang. What reaches the driver is bounded by languages / min_share."""
    require(df, id_col, text_col, lang_col)
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in slices(mine, SLICE):
                    h, n = np.unique(np.concatenate([g for g, _ in ngrams(mine[lo:hi])]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "h", "n"])

    counts = _sample(rows, max_docs, "id", "lang").select("text", "lang").mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilters({})
    total = F.element_at(F.create_map(*[F.lit(v) for kv in totals.items() for v in kv]), F.col("lang"))
    shares = counts.withColumn("p", F.col("n") / total)
    most = shares.groupBy("h").agg(F.max("p").alias("most"), F.collect_list(F.struct("lang", "n", "p")).alias("of"))
    kept = most.select("h", "most", F.explode("of").alias("x")).where((F.col("x.p") >= min_share) & (F.col("x.n") >= min_count) & (F.col("x.p") >= rel * F.col("most")))
    grams: dict[str, list[int]] = {lang: [] for lang in totals}
    for r in kept.select("x.lang", "h").toLocalIterator():
        grams[r["lang"]].append(r["h"])
    return LanguageFilters({k: np.array(v, np.int64).view(np.uint64) for k, v in grams.items()})


def predict(df: DataFrame, model: LanguageFilters, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with lang_pred, score and n_ngrams after its columns."""
    require(df, text_col)
    spark = df.sparkSession
    ship(spark)
    df = df.drop("lang_pred", "score", "n_ngrams")
    at = df.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)  # POSITIONS * 8 bytes for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [shared.value.predict(texts[lo:hi]) for lo, hi in slices(texts, SLICE)]
            if found:
                cols = [pa.array([x for f in found for x in f[0]], pa.string()), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "score", "n_ngrams"])

    return map_batches(df, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_ngrams", T.LongType())])


def language_filter(df: DataFrame, *, train: Column | None = None, min_score: float = MIN_SCORE, **kw) -> DataFrame:
    """The rows of ``df`` whose language is recognised: not ``und``, and a score of at least ``min_score``. All columns stay as they are."""
    text_col = kw.get("text_col", "text")
    model = fit(df.where(train) if train is not None else df, **kw)
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)  # POSITIONS * 8 bytes for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for lo, hi in slices(texts, SLICE):
                langs, score, _ = shared.value.predict(texts[lo:hi])
                keep += [lang != "und" and s >= min_score for lang, s in zip(langs, score.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_batches(df, run, [])
