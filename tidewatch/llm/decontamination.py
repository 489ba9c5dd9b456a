"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words, but some, is one
window). It is found where a document holds all its words in order, a containment of 1, so every one of its
shingles must occur there: its prefix, the shingles that a document has to share, is a single one, and the
rarest is taken. Documents are read once: a document's shingles meet the set of all shingles of windows, and
what is met is written to the shared folder with its position and the words around it. Counts of that table
order a window's shingles by rarity over all documents; windows with a shingle that no document has are out.
The rarest ones are joined with the table, positions at which the window would begin before the document or
end after it are left out (the bounds on position and length), and the words around are compared exactly.

Shingles are joined by a 64-bit hash, which only proposes. The tables of shingles and windows are
broadcast if their measured size is below ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; beyond that they are
joined by shuffles.

Defined results: a null or empty text, and one without a word, has no words and no hits; a null item text
has no window; rows that repeat an item_id are one item, a null item_id is an item written as the empty
text; a window that several items share counts for each; rows that repeat a doc_id are decided on by their
own texts; no items or no documents give no hits or no rows; extra columns play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import require
from tidewatch.session import checkpoint_dir

WINDOW, SHINGLE = 10, 3
#: Between words: what is neither a digit, a letter a-z nor outside ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to which a table is broadcast: rows, and characters of the words in them.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def words_of(text: Column) -> Column:
    """The text's words, A-Z in lower case. Never null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), GAPS, -1), lambda w: w != "")


def _shingle_key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from the position ``at``, counted from 1."""
    return F.xxhash64(*[F.get(words, at + (i - 1)) for i in range(size)])


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): the distinct windows, with the ids of the items that have them, as text. A window of a licence line may have many items."""
    require(benchmark, item_col, text_col)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text_col}`")).alias("all"))
    items = items.where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    return items.select("item", "all", F.explode(starts).alias("at")).select(F.slice("all", F.col("at"), F.lit(window)).alias("words"), "item").distinct()


def _maybe_broadcast(df: DataFrame, rows: int, size: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def matched_shingles(docs: DataFrame, vocabulary: DataFrame, sizes: list[int], *, doc_col: str, text_col: str, window: int, key: str) -> DataFrame:
    """(doc, doc_key, n_words, at, key, around, around_at): a row for each shingle of a document that a window has, and one with ``at`` 0 for the document.

    around: the words that a window with this shingle can cover, from position around_at on.
    """
    text = F.col(f"`{text_col}`").cast("string")
    own = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(f"`{doc_col}`").cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))).cast("binary")))
    rows = docs.select(F.col(f"`{doc_col}`").alias("doc"), own.alias("doc_key"), words_of(text).alias("words"))
    k, least = len(sizes), min(sizes, default=1)
    rows = rows.withColumn("n_words", F.size("words"))
    steps = F.greatest(F.col("n_words") - (least - 1), F.lit(0)) * k
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), steps)).alias("step"))
    at = F.when(F.col("step") > 0, ((F.col("step") - 1) / k).cast("int") + 1).otherwise(0)
    rows = rows.withColumn("at", at)
    hashed = F.xxhash64("doc_key")  # spreads the documents' own rows; that it may equal a shingle's does not matter
    for i, s in enumerate(sizes):
        hashed = F.when((F.col("step") > 0) & ((F.col("step") - 1) % k == i), _shingle_key(F.col("words"), F.col("at"), s)).otherwise(hashed)
    met = rows.withColumn(key, hashed).join(vocabulary.withColumn("known", F.lit(True)), key, "left").where((F.col("at") == 0) | F.col("known"))
    first = F.greatest(F.col("at") - (window - least), F.lit(1))
    around = F.when(F.col("at") > 0, F.slice("words", first, F.col("at") + F.lit(window) - first))
    return met.select("doc", "doc_key", "n_words", "at", key, around.alias("around"), first.alias("around_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): a row for each document, and a row for each occurrence of a window in one.

    documents: (doc, doc_key, n_words, n_hit, items): n_hit words lie in a window; items have one, sorted as text.
    spans: (doc_key, start, length, words): start is the first word's position, counted from 1. doc_key is a
    digest of the document's id and text.
    """
    require(docs, doc_col, text_col)
    spark, at = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/decontamination-{uuid.uuid4().hex}"
    benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window).write.parquet(f"{at}/windows")
    owners = spark.read.parquet(f"{at}/windows")
    windows = owners.select("words").distinct()
    length = F.size("words")
    measured = windows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.array_join("words", " "))).alias("size"), F.collect_set(F.least(length, F.lit(shingle))).alias("sizes"), F.sum(length).alias("shingles")).first()
    sizes = sorted(measured["sizes"])  # at most ``shingle`` numbers
    # every shingle of every window, with its offset
    shingles = windows.withColumn("s", F.least(length, F.lit(shingle))).select("words", "s", F.explode(F.sequence(F.lit(1), length - F.col("s") + 1)).alias("offset"))
    key = F.lit(None).cast("long")
    for s in sizes:
        key = F.when(F.col("s") == s, _shingle_key(F.col("words"), F.col("offset"), s)).otherwise(key)
    shingles = shingles.withColumn("key", key)
    vocabulary = shingles.select("key").distinct()
    vocabulary = _maybe_broadcast(vocabulary, measured["shingles"] or 0, 16 * (measured["shingles"] or 0))
    matched_shingles(docs, vocabulary, sizes, doc_col=doc_col, text_col=text_col, window=window, key="key").write.parquet(f"{at}/matched")
    matched = spark.read.parquet(f"{at}/matched")
    found = matched.where("at > 0")

    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    ranked = shingles.join(_maybe_broadcast(counts, measured["shingles"] or 0, 16 * (measured["shingles"] or 0)), "key", "left")
    rarest = F.min_by(F.struct("key", "offset", "rows"), F.struct(F.coalesce("rows", F.lit(0)), "key", "offset"))
    prefixes = ranked.groupBy("words").agg(rarest.alias("x")).where("x.rows is not null").select("words", "x.key", "x.offset", length.alias("length"))
    prefixes = _maybe_broadcast(prefixes, measured["rows"], measured["size"] or 0)
    met = found.join(prefixes, "key").withColumn("start", F.col("at") - F.col("offset") + 1)
    met = met.where((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("n_words")))
    met = met.where(F.slice("around", F.col("start") - F.col("around_at") + 1, F.col("length")) == F.col("words"))
    met.select("doc_key", "start", "length", "words").write.parquet(f"{at}/spans")
    spans = spark.read.parquet(f"{at}/spans")

    before = Window.partitionBy("doc_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hits = spans.select("doc_key", new.alias("new")).groupBy("doc_key").agg(F.sum("new").alias("n_hit"))
    named = spans.select("doc_key", "words").distinct().join(_maybe_broadcast(owners, measured["rows"], measured["size"] or 0) if owners.count() <= BROADCAST_ROWS else owners, "words")
    items = named.select("doc_key", "item").distinct().groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    documents = matched.where("at = 0").select("doc", "doc_key", "n_words").join(hits, "doc_key", "left").join(items, "doc_key", "left")
    none = F.array().cast("array<string>")
    return documents.select("doc", "doc_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")), spans
