"""Queries over labelled samples (name, labels, value, ts) of counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, series: list[str]) -> DataFrame:
    """Each sample's increase over the one before and the seconds between; after a reset, the new value is the increase."""
    order = Window.partitionBy(*series).orderBy("ts")
    delta = F.col("value") - F.lag("value").over(order)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))) / 1e6
    return samples.withColumns({"increase": F.when(delta < 0, F.col("value")).otherwise(delta), "seconds": seconds})


def rate(samples: DataFrame, series: list[str], bucket: str = "1 minute") -> DataFrame:
    """Increase per bucket, and per second of it."""
    size = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {bucket}) / 1e6")
    got = increases(samples, series).where("increase is not null").groupBy(*series, F.window(F.col("ts").cast("timestamp"), bucket).alias("w")).agg(F.sum("increase").alias("increase"))
    return got.select(*series, F.col("w.start").alias("bucket"), "increase", (F.col("increase") / size).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, series: list[str]) -> DataFrame:
    """Interpolated quantile of cumulative buckets (le, value): linear within the bucket that the rank falls in, from 0 below the
    first; the highest finite bound for the last bucket; null without samples."""
    each = Window.partitionBy(*series)
    order = each.orderBy("le")
    rows = buckets.withColumns({"total": F.max("value").over(each), "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "under": F.coalesce(F.lag("value").over(order), F.lit(0.0))})
    rank = F.col("total") * q
    reached = rows.where((F.col("value") >= rank) & (F.col("total") > 0)).groupBy(*series).agg(F.min_by(F.struct("le", "low", "under", "value", "total"), F.col("le")).alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * F.coalesce(F.try_divide(F.col("b.total") * q - F.col("b.under"), F.nullif(F.col("b.value") - F.col("b.under"), F.lit(0.0))), F.lit(0.0))
    return reached.select(*series, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(inside).alias("quantile"))


def ratio(samples: DataFrame, by: list[str], good) -> DataFrame:
    """Sum of values where ``good`` holds over the sum of all; null over nothing."""
    return samples.groupBy(*by).agg(F.try_divide(F.sum(F.when(good, F.col("value")).otherwise(0.0)), F.nullif(F.sum("value"), F.lit(0.0))).alias("ratio"))


def share(samples: DataFrame, by: str) -> DataFrame:
    """Sum by label, and its share of everything."""
    sums = samples.groupBy(by).agg(F.sum("value").alias("total"))
    return sums.withColumn("share", F.try_divide(F.col("total"), F.nullif(F.sum("total").over(Window.partitionBy()), F.lit(0.0))))


def mean(samples: DataFrame, by: list[str], total: str = "sum_value", count: str = "count_value") -> DataFrame:
    return samples.groupBy(*by).agg(F.try_divide(F.sum(total), F.nullif(F.sum(count), F.lit(0))).alias("mean"))


def tier_costs(tiers: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Bytes of a tier times its price a GB."""
    price = F.lit(None).cast("double")
    for name, p in prices.items():
        price = F.when(F.col("tier") == name, F.lit(p)).otherwise(price)
    return tiers.withColumn("cost", F.col("bytes") / 1e9 * price)


def held(samples: DataFrame, series: list[str], condition, minutes: int = 5) -> DataFrame:
    """Samples at which the condition has held for the whole of the last ``minutes``, and at least so long a time is covered."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = samples.withColumn("_t", micros).withColumn("_ok", condition.cast("int"))
    span = Window.partitionBy(*series).orderBy("_t").rangeBetween(-minutes * 60_000_000, 0)
    start = F.min("_t").over(Window.partitionBy(*series).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_all": F.min("_ok").over(span), "_since": start}).where((F.col("_all") == 1) & (F.col("_t") - F.col("_since") >= minutes * 60_000_000)).drop("_t", "_ok", "_all", "_since")
