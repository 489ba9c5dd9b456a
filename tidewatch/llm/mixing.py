"""Mixing sources to target weights with nested hash thresholds, without sorting documents.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share the whole size; a
target stops at three times its source's size and the excess goes to the others by weight (water
filling, in closed form over the sources' table). A source with target t and size s takes every
document floor(t / s) times; the rest of t comes from documents whose hash lies below a threshold.

The threshold: sizes are summed by source and the hash's leading bits, the running sum finds the bucket
in which the budget ends, and only that bucket is summed again by the next bits, until all 60 bits are
used. What then is left is one hash value; it is taken if that brings the source nearer to its target.
Documents are never sorted or collected, and the histograms are pre-aggregated; a source's threshold
meets its documents in a join salted over the source.

Defined results: a null or wordless text has size 0 and takes 0 words; a null source is a source, the
last in order; rows that repeat a doc_id share its hash and are taken together; a null doc_id hashes as
the empty text; an empty table gives no rows; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, fresh, require
from tidewatch.session import cut

WEIGHTS = (5, 2, 1)
#: A target's largest multiple of its source's size.
MAX_REPEAT = 3
#: Bits of the hash that each level of histograms takes: 60 in all.
LEVELS = (12, 16, 16, 16)
SALTS = 64
#: Sources up to which their thresholds are broadcast (under 1 MB); beyond it the join is salted.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of md5 of the id's decimal text: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sized (source, size) -> (source, source_size long, target double). One row for each source meets in one task, not documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", rank.alias("rank"), (F.col("source_size") * max_repeat).alias("cap")).withColumn("weight", weight)
    order = [F.col("cap") / F.col("weight"), F.col("rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If all sources before this one stop at their caps, the others share what is left at this level.
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("level", F.first(fits, ignorenulls=True).over(whole))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(source, source_size, target, times long, below long): documents are taken ``times`` times, and once more if hash < below."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    state = cut(state.select("source", "source_size", "target", "times", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("have"), F.lit(0.0).alias("unit")))
    used, total = 0, sum(levels)
    rows = sized.select("source", "size", "h")
    for bits in levels:
        used += bits
        shift = total - used
        bucket = F.shiftright("h", shift)
        if used == bits:
            hist = rows
        else:
            edge = state.where("need > 0").select(F.col("source").alias("b_source"), F.col("prefix").alias("b_prefix"))
            hist = rows.join(edge, F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("h", shift + bits) == F.col("b_prefix")), "left_semi")
        hist = hist.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).select(F.col("source").alias("h_source"), "bucket", "n", "upto")
        hit = state.join(hist, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("need") > 0) & (F.col("have") + F.col("upto") >= F.col("need")), "left")
        state = cut(
            hit.groupBy("source", "source_size", "target", "times", "need")
            .agg(F.min(F.struct("bucket", "upto", "n")).alias("x"), F.first("prefix").alias("prefix"), F.first("have").alias("have"))
            .select("source", "source_size", "target", "times", "need", F.coalesce("x.bucket", F.shiftleft("prefix", bits)).alias("prefix"), (F.col("have") + F.coalesce(F.col("x.upto") - F.col("x.n"), F.lit(0))).alias("have"), F.coalesce(F.col("x.n"), F.lit(0)).cast("double").alias("unit"))
        )
    nearer = 2 * (F.col("need") - F.col("have")) > F.col("unit")
    below = F.when(F.col("need") <= 0, 0).otherwise(F.col("prefix") + F.when(nearer, 1).otherwise(0)).cast("long")
    return state.select("source", "source_size", "target", "times", below.alias("below"))


def _with_times(df: DataFrame, id_col: str, text_col: str, source_col: str, **kw) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns for hash, source_size, target and times, and their names, which ``df`` does not have."""
    require(df, id_col, text_col, source_col)
    parts = ("hash", "named", "source_size", "target", "base", "below", "salt", "part", "times")
    name = dict(zip(parts, fresh(df, *(f"mix_{p}" for p in parts)), strict=True))
    doc_id, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    sized = cut(df.select(doc_id.alias("doc_id"), source.alias("source"), size_of(text).alias("size"), hash60(doc_id).alias("h")))
    goals = cut(targets(sized, **kw))
    limits = thresholds(sized, goals).select(F.col("source").alias(name["named"]), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]), F.col("times").alias(name["base"]), F.col("below").alias(name["below"]))
    same = source.eqNullSafe(F.col(name["named"]))
    df = df.withColumn(name["hash"], hash60(doc_id)).withColumn(name["salt"], (F.col(name["hash"]) % SALTS).cast("int"))
    if goals.count() <= BROADCAST_SOURCES:
        met = df.join(F.broadcast(limits), same)
    else:
        met = df.join(limits.withColumn(name["part"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col(name["salt"]) == F.col(name["part"])))
    return met.withColumn(name["times"], (F.col(name["base"]) + F.when(F.col(name["hash"]) < F.col(name["below"]), 1).otherwise(0)).cast("long")), name


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken): ``times`` is how often the mix takes the document."""
    met, name = _with_times(df, id_col, text_col, source_col, **kw)
    size, times = F.col(fresh(met, "mix_size")[0]), F.col(name["times"])
    met = met.withColumn(fresh(met, "mix_size")[0], size_of(F.col(f"`{text_col}`").cast("string")))
    return met.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.col(name["source_size"]).alias("source_size"), F.col(name["target"]).alias("target"), times.alias("times"), (times * size).alias("taken"))


def mix_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it takes it. Columns are unchanged."""
    met, name = _with_times(df, id_col, text_col, source_col, **kw)
    copy = fresh(met, "copy")[0]
    met = met.where(F.col(name["times"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(name["times"]))))
    return met.select(*[f"`{c}`" for c in df.columns])
