"""Exact quantiles of groups of any size, by nested histograms over the bits of doubles.

A double's bits, turned so that they sort as its value does, are read 16 at a time: a histogram of the first 16
bits tells in which bucket a wanted rank lies, one of the next 16 bits of that bucket's values where inside it, and
after four passes all 64 bits of the value at that rank are known. Every pass is one aggregation with at most
65,536 counts for each wanted rank, whatever the number of values; no group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut, ship

BITS, PASSES = 16, 4
#: Wanted ranks up to which their table is broadcast (some 40 bytes each).
BROADCAST_RANKS = 100_000


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles to integers in their order; -0.0 is 0.0."""
    bits = (v + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _double(k: np.ndarray) -> np.ndarray:
    return (k ^ ((k >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _mapped(df: DataFrame, column: str, out: str, kind: str, run) -> DataFrame:
    """``df`` with ``out`` = run(``column``) in Arrow batches."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run(b.column(column).to_numpy(zero_copy_only=False)))], names=[*b.schema.names, out])

    return df.mapInArrow(each, f"{fields}, `{out}` {kind}")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """(keys, p, quantile): linear between the two values next to the rank p (n - 1), as ``percentile``. Null and NaN values play no part; a group without others has no rows."""
    ship(df.sparkSession)
    keys, names = list(keys), [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = cut(_mapped(rows, "v", "bits", "long", _sortable).drop("v"))
    exploded = F.explode(F.array(*[F.lit(float(p)) for p in ps]))
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(*names, "n", exploded.alias("p"))
    at = F.col("p") * (F.col("n") - 1)
    wanted = counted.select(*names, "p", (at - F.floor(at)).alias("share"), F.explode(F.array(F.struct(F.floor(at).alias("rank"), F.lit(0).alias("side")), F.struct(F.ceil(at).alias("rank"), F.lit(1).alias("side")))).alias("x"))
    places = cut(wanted.select(*names, "p", "share", "x.side", "x.rank"))
    ranks = places.select(*names, "rank").distinct().withColumns({"left": F.col("rank"), "prefix": F.lit(0).cast("long")})

    def same(a: str, b: str):
        on = F.lit(True)
        for n in names:
            on = on & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
        return on

    for done in range(PASSES):
        shift = 64 - BITS * (done + 1)
        # The bits so far as a prefix, the next ones as a bucket; the first 16 carry the sign, moved so that they start from 0.
        bucket = F.shiftright("bits", shift).bitwiseAND(F.lit(2**BITS - 1)) if done else F.shiftright("bits", shift) + 2 ** (BITS - 1)
        prefix = F.shiftright("bits", 64 - BITS * done) if done else F.lit(0).cast("long")
        prefixes = ranks.select(*names, "prefix").distinct()
        small = prefixes.count() <= BROADCAST_RANKS
        met = rows.withColumns({"prefix": prefix, "bucket": bucket})
        if done:
            met = met.alias("a").join((F.broadcast(prefixes) if small else prefixes).alias("b"), same("a", "b") & (F.col("a.prefix") == F.col("b.prefix")), "left_semi")
        counts = met.groupBy(*names, "prefix", "bucket").agg(F.count(F.lit(1)).alias("c"))
        below = F.coalesce(F.sum("c").over(Window.partitionBy(*names, "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("below", below)  # at most 65,536 rows of a prefix
        own = (F.broadcast(ranks) if small else ranks).alias("r")
        found = counts.alias("c").join(own, same("c", "r") & (F.col("c.prefix") == F.col("r.prefix")) & (F.col("c.below") <= F.col("r.left")) & (F.col("r.left") < F.col("c.below") + F.col("c.c")))
        part = F.col("c.bucket") - (2 ** (BITS - 1) if done == 0 else 0)
        whole = F.shiftleft(F.col("c.prefix"), BITS) + part if done else part
        ranks = cut(found.select(*[F.col(f"c.{n}").alias(n) for n in names], "r.rank", (F.col("r.left") - F.col("c.below")).alias("left"), whole.cast("long").alias("prefix")))
    values = _mapped(ranks.select(*names, "rank", "prefix"), "prefix", "v", "double", _double)
    met = places.alias("p").join(values.alias("v"), same("p", "v") & (F.col("p.rank") == F.col("v.rank")))
    sides = met.groupBy(*[F.col(f"p.{n}").alias(n) for n in names], F.col("p.p").alias("p"), F.col("p.share").alias("share")).agg(F.max(F.when(F.col("p.side") == 0, F.col("v.v"))).alias("lo"), F.max(F.when(F.col("p.side") == 1, F.col("v.v"))).alias("hi"))
    between = F.when(F.col("share") == 0, F.col("lo")).otherwise(F.col("lo") * (1 - F.col("share")) + F.col("hi") * F.col("share"))
    return sides.select(*[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)], "p", between.alias("quantile"))
