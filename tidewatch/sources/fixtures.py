"""A demo economy: vintage series derived from the orders and lineitem tables.

Every observation has two vintages: the first release counts a fixed subset of the orders, the revision
counts all. Both come from one pass over each table, by conditional sums.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.config import SeriesMeta, load_series_meta
from tidewatch.functions.dates import release_date
from tidewatch.session import table

CONFIG = Path(__file__).resolve().parents[2] / "config" / "retail_demo.yaml"
TARGET = "revenue_growth"
#: Share of the orders, in tenths by order key, that a first release knows.
FIRST_MONTHLY, FIRST_QUARTERLY = 9, 8
PANEL_START, PANEL_END = "1995-01-01", "2001-12-31"


def demo_meta() -> dict[str, SeriesMeta]:
    return load_series_meta(CONFIG)


def _vintages(df: DataFrame, period: Column, aggregates: dict[str, tuple], tenths: int, key: str) -> DataFrame:
    """(series, ref_period, vint, value): each aggregate over a period's first-release rows (vint 0) and over all (vint 1)."""
    early = F.pmod(F.col(key), F.lit(10)) < tenths
    sums = []
    for name, (agg, x) in aggregates.items():
        sums += [agg(F.when(early, x)).alias(f"{name}0"), agg(x).alias(f"{name}1")]
    per = df.groupBy(period.alias("ref_period")).agg(F.count_if(early).alias("n0"), F.count(F.lit(1)).alias("n1"), *sums)
    rows = [F.struct(F.lit(name).alias("series"), F.lit(v).alias("vint"), F.when(F.col(f"n{v}") > 0, F.col(f"{name}{v}").cast("double")).alias("value"), F.col(f"n{v}").alias("n")) for name in aggregates for v in (0, 1)]
    return per.select("ref_period", F.explode(F.array(*rows)).alias("x")).select("x.series", "ref_period", "x.vint", "x.value", "x.n").where("n > 0")


def demo_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ref_period, vint int, value rounded to 6 places)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"), F.col("o_orderpriority").alias("priority"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_discount").cast("decimal(18,4)").alias("disc"))
    month = F.trunc("d", "MONTH")
    monthly_orders = _vintages(orders, month, {"order_value": (F.sum, F.col("p")), "order_count": (F.count, F.lit(1))}, FIRST_MONTHLY, "k")
    monthly_items = _vintages(items, month, {"ship_quantity": (F.sum, F.col("q")), "discount_level": (F.sum, F.col("disc"))}, FIRST_MONTHLY, "k")
    monthly_items = monthly_items.withColumn("value", F.when(F.col("series") == "discount_level", F.col("value") / F.col("n")).otherwise(F.col("value")))
    quarterly = _vintages(orders, F.trunc("d", "QUARTER"), {TARGET: (F.sum, F.col("p"))}, FIRST_QUARTERLY, "k")
    before = F.lag("value").over(Window.partitionBy("series", "vint").orderBy("ref_period"))
    growth = quarterly.withColumn("value", 100 * (F.col("value") / before - 1)).where("value is not null")
    saturday = F.date_add(F.trunc("d", "WEEK"), 5)
    weekly = orders.where("priority = '1-URGENT'").groupBy(saturday.alias("ref_period")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    weekly = weekly.select(F.lit("urgent_orders").alias("series"), "ref_period", F.lit(1).alias("vint"), "value")
    out = monthly_orders.drop("n").unionByName(monthly_items.drop("n")).unionByName(growth.drop("n")).unionByName(weekly)
    return out.select("series", "ref_period", "vint", F.round("value", 6).alias("value"))


def demo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long raw table: a vintage is dated its release plus 30 days a revision; weekly orders have no vintages."""
    metas = demo_meta()
    freq, lag = (F.create_map(*[F.lit(x) for k, m in metas.items() for x in (k, v(m))]) for v in (lambda m: m.freq, lambda m: m.release_lag_days))
    series = F.col("series")
    vintage = F.date_add(release_date(F.col("ref_period"), freq[series], lag[series]), F.col("vint") * 30)
    final = [k for k, m in metas.items() if m.vintage_source == "final"]
    return demo_values(spark, sf_dir).select("series", "ref_period", F.when(~series.isin(final), vintage).alias("vintage_date"), "value")
