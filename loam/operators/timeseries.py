"""Trends, anomalies, correlations and change points of metric series.

Metric points are (metric_name, system_id, timestamp, value, seq); seq is the order of arrival. A window is the time from
``as_of`` minus its days on, without an end. Series are told apart by ``by``: the metric, or the metric and system.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINIMUM_POINTS = {"trend": 2, "anomaly": 10, "pair": 5}


def windowed(points: DataFrame, as_of: str, days: int = 7, metric: str | None = None, system_id: str | None = None) -> DataFrame:
    start = F.lit(as_of).cast(points.schema["timestamp"].dataType) - F.make_dt_interval(F.lit(days))
    out = points.where(F.col("timestamp") >= start)
    out = out if metric is None else out.where(F.col("metric_name") == metric)
    return out if system_id is None else out.where(F.col("system_id") == system_id)


def trends(points: DataFrame, as_of: str, days: int = 7, by: tuple[str, ...] = ("metric_name", "system_id"), **only: str) -> DataFrame:
    """Least-squares line over the ordinal of each point in time order; series of fewer than two points have none.

    The ordinal needs the points of a series in order, one window over the series' key; sums follow in the same stage.
    """
    order = Window.partitionBy(*by).orderBy("timestamp", "seq")
    at = windowed(points, as_of, days, **only).withColumn("x", (F.row_number().over(order) - 1).cast("double"))
    when = F.struct("timestamp", "seq")
    fitted = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_r2("value", "x").alias("r2"), F.var_pop("value").alias("spread"), F.min_by("value", when).alias("first"), F.max_by("value", when).alias("last"), F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"))
    direction = F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    change = F.when(F.col("first") == 0, 0.0).otherwise(F.try_divide(F.col("last") - F.col("first"), F.nullif(F.col("first"), F.lit(0.0))) * 100)
    return fitted.where(F.col("n") >= MINIMUM_POINTS["trend"]).select(*by, direction.alias("trend_direction"), F.when(F.col("spread") == 0, 0.0).otherwise(F.col("r2")).alias("trend_strength"), change.alias("percent_change"), F.least(F.lit(1.0), F.col("n") / 100.0).alias("confidence"), "slope", F.col("n").alias("points"), "range_start", "range_end")


def scored(points: DataFrame, as_of: str, days: int = 7, by: tuple[str, ...] = ("metric_name", "system_id"), **only: str) -> DataFrame:
    """Points with mean, population deviation, z and count of their series; series of fewer than ten points are left out.

    Statistics are aggregated (partial sums before the shuffle) and joined back; the join is on few rows, one a series.
    """
    rows = windowed(points, as_of, days, **only)
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).where(F.col("n") >= MINIMUM_POINTS["anomaly"])
    deviation = F.col("value") - F.col("mean")
    z = F.when(F.col("std") > 0, F.abs(F.try_divide(deviation, F.col("std")))).otherwise(0.0)
    return rows.join(stats, list(by)).withColumns({"z_score": z, "deviation": deviation})


def anomalies(points: DataFrame, as_of: str, days: int = 7, threshold: float = 3.0, by: tuple[str, ...] = ("metric_name", "system_id"), **only: str) -> DataFrame:
    """Points whose z is over ``threshold``."""
    names = list(dict.fromkeys([*by, "system_id", "timestamp", "value", "z_score", "deviation", "seq"]))
    return scored(points, as_of, days, by, **only).where(F.col("z_score") > threshold).select(*names)


def anomaly_summary(points: DataFrame, as_of: str, days: int = 7, threshold: float = 3.0, by: tuple[str, ...] = ("metric_name",), first: int = 10, **only: str) -> DataFrame:
    """Per series: points, anomalies, their rate, and the seq of the first ``first`` anomalies in order of arrival."""
    hit = F.col("z_score") > threshold
    rows = scored(points, as_of, days, by, **only)
    # a limit on row numbers is applied in each task before the shuffle
    early = rows.where(hit).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).where(F.col("rank") <= first)
    picked = early.groupBy(*by).agg(F.array_sort(F.collect_list("seq")).alias("first_seqs"))
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_points"), F.count_if(hit).alias("anomaly_count"), F.avg(hit.cast("double")).alias("anomaly_rate"))
    none = F.array().cast(f"array<{points.schema['seq'].dataType.simpleString()}>")
    return found.join(picked, list(by), "left").withColumn("first_seqs", F.coalesce("first_seqs", none))


def correlations(points: DataFrame, as_of: str, days: int = 7, last: int = 100, align: str = "arrival", threshold: float | None = None, **only: str) -> DataFrame:
    """Pearson's r for each pair of systems of a metric, system_1 < system_2.

    The last ``last`` values of each system in order of arrival are aligned from the end (``align="hour"``: means of each hour are aligned by
    time). Metrics of fewer than ten points, and systems of fewer than five, are left out; r is 0 for fewer than five shared places or
    a constant side. With ``threshold`` only larger sizes are returned. A series' tail is bounded before the join.
    """
    rows = windowed(points, as_of, days, **only)
    total = rows.groupBy("metric_name").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= 10).select("metric_name")
    each = Window.partitionBy("metric_name", "system_id")
    if align == "hour":
        tail = rows.groupBy("metric_name", "system_id", F.date_trunc("hour", "timestamp").alias("place")).agg(F.avg("value").alias("value")).withColumn("n", F.count(F.lit(1)).over(each))
    else:
        tail = rows.withColumn("place", F.row_number().over(each.orderBy(F.col("seq").desc()))).where(F.col("place") <= last).withColumn("n", F.count(F.lit(1)).over(each))
    tail = tail.where(F.col("n") >= MINIMUM_POINTS["pair"]).join(total, "metric_name", "left_semi").select("metric_name", "system_id", "place", "value")
    a, b = (tail.select("metric_name", "place", F.col("system_id").alias(f"system_{k}"), F.col("value").alias(v)) for k, v in ((1, "x"), (2, "y")))
    pairs = a.join(b, ["metric_name", "place"]).where("system_1 < system_2").groupBy("metric_name", "system_1", "system_2")
    r = F.coalesce(F.try_divide(F.covar_pop("x", "y"), F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))), F.lit(0.0))
    found = pairs.agg(F.count(F.lit(1)).alias("points"), r.alias("r")).withColumn("correlation", F.when(F.col("points") >= MINIMUM_POINTS["pair"], F.col("r")).otherwise(0.0)).drop("r")
    strength = F.when(F.abs("correlation") > 0.7, "strong").when(F.abs("correlation") > 0.5, "moderate").otherwise("weak")
    found = found.withColumn("strength", strength)
    return found if threshold is None else found.where(F.abs("correlation") > threshold)


def catalog(points: DataFrame) -> DataFrame:
    """Metrics with their points, systems and time range."""
    return points.groupBy("metric_name").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("system_id").alias("systems"), F.min("timestamp").alias("range_start"), F.max("timestamp").alias("range_end"))


def metric_names(points: DataFrame) -> DataFrame:
    return points.select("metric_name").distinct()


def system_count(points: DataFrame, metric: str) -> DataFrame:
    return points.where(F.col("metric_name") == metric).agg(F.countDistinct("system_id").alias("systems"))


def rollup(points: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    """avg, min, max and count of each bucket, metric and system; the same expression runs on a stream with a watermark."""
    return points.groupBy(F.window("timestamp", bucket).alias("w"), "metric_name", "system_id").agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "metric_name", "system_id", "avg_value", "min_value", "max_value", "n")


def rollup_tier(hours: float) -> str:
    """The table that answers a range: raw below a day, 5-minute buckets below 30 days, hourly ones beyond."""
    return "raw" if hours < 24 else "5m" if hours < 720 else "1h"


SEGMENTS = "metric_name string, entity_id string, segment int, segment_start timestamp, segment_end timestamp, points int, days double, direction string, total_change double, change_rank int, trend_class string, is_latest boolean, has_abrupt boolean, abrupt_count int, range_start timestamp, range_end timestamp"


def change_points(series: DataFrame, as_of: str, days: int = 30, penalty: float = 3.0, least: int = 2, abrupt: float = 3.0) -> DataFrame:
    """Segments of each (metric_name, entity_id) series of (ts, value), split where the level changes.

    Binary segmentation: the split that lowers the squared error most is kept if the gain is over ``penalty`` * log(n) noise variances,
    noise being judged from first differences, 3 % of the range at least; then both sides are tried. A segment's total change is its mean less the one before (within the
    first: its last value less its first). It is abrupt if the step is over ``abrupt`` noise deviations and 10 % of the level before it, else gradual
    if its own slope is, else flat. change_rank 1 is the largest change. Series of fewer than five usable points have no row; unreadable times and values are left out.
    """
    rows = series.select("metric_name", "entity_id", F.try_to_timestamp(F.col("ts").cast("string")).alias("ts"), F.col("value").cast("double").alias("value")).where("ts is not null and value is not null and not isnan(value)")
    rows = rows.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        if len(pdf) < 5:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("ts", kind="stable")
        v, n = pdf["value"].to_numpy(), len(pdf)
        steps = np.diff(v)
        noise = max(1.4826 * float(np.median(np.abs(steps - np.median(steps)))) / 2**0.5, 0.03 * float(np.ptp(v)), 1e-9)
        cuts, todo = [0, n], [(0, n)]
        while todo:
            a, b = todo.pop()
            if b - a < 2 * least:
                continue
            part = v[a:b]
            # a steady slope is no change of level: it is taken out before the gain of a split is judged
            k = np.arange(least, b - a - least + 1)
            left, right = np.cumsum(part)[k - 1] / k, (part.sum() - np.cumsum(part)[k - 1]) / (b - a - k)
            gain = k * (b - a - k) / (b - a) * (left - right) ** 2
            best = int(np.argmax(gain))
            jump = abs(v[a + k[best]] - v[a + k[best] - 1])
            if gain[best] > penalty * np.log(n) * noise**2 and jump > abrupt * noise and jump > 0.5 * abs(left[best] - right[best]):
                cuts.append(a + int(k[best]))
                todo += [(a, a + int(k[best])), (a + int(k[best]), b)]
        cuts = sorted(cuts)
        out, t = [], pdf["ts"]
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            before = v[cuts[s - 1] : a].mean() if s else None
            inner = float(v[b - 1] - v[a])
            change = float(v[a:b].mean() - before) if s else inner
            sharp = bool(s) and abs(change) > abrupt * noise and abs(change) > 0.1 * abs(before)
            slope = np.polyfit(np.arange(b - a), v[a:b], 1)[0] if b - a > 1 else 0.0
            kind = "abrupt" if sharp else "gradual" if abs(slope) * (b - a) > abrupt * noise and abs(slope) > 0.01 else "flat"
            direction = "up" if change > noise else "down" if change < -noise else "flat"
            out.append([pdf["metric_name"].iloc[0], pdf["entity_id"].iloc[0], s, t.iloc[a], t.iloc[b - 1], b - a, (t.iloc[b - 1] - t.iloc[a]).total_seconds() / 86400, direction, change, 0, kind, b == n])
        order = sorted(range(len(out)), key=lambda k: -abs(out[k][8]))
        for rank, k in enumerate(order, 1):
            out[k][9] = rank
        sharp = sum(x[10] == "abrupt" for x in out)
        return pd.DataFrame([[*x, sharp > 0, sharp, t.iloc[0], t.iloc[-1]] for x in out], columns=names)

    return rows.groupBy("metric_name", "entity_id").applyInPandas(run, SEGMENTS)


def first_last(points: DataFrame, by: tuple[str, ...] = ("metric_name", "system_id")) -> DataFrame:
    when = F.struct("timestamp", "seq")
    return points.groupBy(*by).agg(F.min_by("value", when).alias("first_value"), F.max_by("value", when).alias("last_value"))


def change_rank(changes: DataFrame, by: tuple[str, ...], change: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows ranked by the size of their change within a series, 1 the largest, equal ones in the order of ``ties``."""
    return changes.withColumn("change_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.abs(change).desc(), *ties)))
