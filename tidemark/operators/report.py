"""Telemetry: deltas, distributions, trends, rankings and comparisons of counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import running_total


def step_deltas(rows: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """Each row with ``delta``: the counter's rise since the row before within ``by``, never below 0."""
    before = F.lag(counter).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("delta", F.greatest(F.coalesce(F.col(counter) - before, F.lit(0)), F.lit(0)))


def window_delta(rows: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """(by, first, last, rise, most): first and last value, the rise between them (at least 0) and the largest value."""
    held = rows.groupBy(by).agg(F.min_by(counter, order).alias("first"), F.max_by(counter, order).alias("last"), F.max(counter).alias("most"))
    return held.select(by, "first", "last", F.greatest(F.col("last") - F.col("first"), F.lit(0)).alias("rise"), "most")


def distribution(rows: DataFrame, value: str, mean: Column | None = None) -> DataFrame:
    """(n, min, max, avg, p50, p95); percentiles by nearest rank, ``mean`` in place of the plain average if given.

    Values are counted and the counts added up range by range; the two percentiles come by way of the driver.
    """
    held = running_total(rows.select(F.col(value).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("c")), "value", "c")
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col("value")))
    p50, p95 = held.agg(at(0.5), at(0.95)).first()
    kind = rows.schema[value].dataType
    mean = F.avg(value) if mean is None else mean
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), mean.alias("avg"), F.lit(p50).cast(kind).alias("p50"), F.lit(p95).cast(kind).alias("p95"))


def summary(rows: DataFrame, order: str, counters: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: of each counter ``_first``, ``_last``, ``_rise`` (at least 0) and ``_most``, and each ratio, the rise of
    one counter over that of another, 0 without a rise of that. One aggregation."""
    held = rows.agg(*(a for c in counters for a in (F.min_by(c, order).alias(f"{c}_first"), F.max_by(c, order).alias(f"{c}_last"), F.max(c).alias(f"{c}_most"))))
    held = held.withColumns({f"{c}_rise": F.greatest(F.col(f"{c}_last") - F.col(f"{c}_first"), F.lit(0)) for c in counters})
    share = lambda part, whole: F.when(F.col(f"{whole}_rise") > 0, F.col(f"{part}_rise").cast("double") / F.col(f"{whole}_rise")).otherwise(0.0)
    return held.withColumns({name: share(*pair) for name, pair in ratios.items()})


def roll_up(sources: dict[str, DataFrame], order: str, tie: str, n: int, metrics: list[str], passed: Column, limits: dict[str, tuple[float, float]], warn: float = 0.9, critical: float = 0.7) -> DataFrame:
    """One row on several sources together: rows and pass rate of all, the series of each metric over the ``n`` newest
    rows (``_n``, ``_low``, ``_high``, ``_mean``), its newest value (``_latest``), and ``health``.

    ``limits`` gives a metric's (warning, critical) values, which its newest value must not exceed. The tier is the
    worst of those and of the pass rate's; a missing value does no harm.
    """
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    newest = latest(tagged, order, tie, n)
    whole = reduce(DataFrame.unionByName, tagged)
    rate = pass_rate(whole, passed, warn, critical).select("n", "passed", "rate", F.col("health").alias("rated"))
    by_time = lambda m: F.max_by(m, F.when(F.col(m).isNotNull(), F.struct(order, tie)))
    held = newest.agg(*(a for m in metrics for a in (F.count(m).alias(f"{m}_n"), F.min(m).alias(f"{m}_low"), F.max(m).alias(f"{m}_high"), F.avg(m).alias(f"{m}_mean"), by_time(m).alias(f"{m}_latest"))))
    row = rate.first()  # one row each
    held = held.select(*(F.lit(row[c]).cast(rate.schema[c].dataType).alias(c) for c in ("n", "passed", "rate")), "*")
    above = lambda i: reduce(Column.__or__, (F.coalesce(F.col(f"{m}_latest") > limits[m][i], F.lit(False)) for m in limits), F.lit(False))
    return held.withColumn("health", F.when(above(1) | F.lit(row["rated"] == "critical"), "critical").when(above(0) | F.lit(row["rated"] == "warning"), "warning").otherwise("healthy"))


def latest(sources: list[DataFrame], order: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows of several sources together."""
    union = sources[0]
    for other in sources[1:]:
        union = union.unionByName(other)
    return union.orderBy(F.desc(order), F.desc(tie)).limit(n)


def series(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def pass_rate(rows: DataFrame, passed: Column, warn: float = 0.9, critical: float = 0.7) -> DataFrame:
    """(n, passed, rate, health): critical or warning if the rate is below that threshold, else healthy."""
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed")).withColumn("rate", F.try_divide(F.col("passed").cast("double"), F.col("n").cast("double")))
    return held.withColumn("health", F.when(F.col("rate") < critical, "critical").when(F.col("rate") < warn, "warning").otherwise("healthy"))


def rank_stages(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """(stage, p95, most, score, place): score = p95 * 1000 + most, best first, ties by name."""
    held = rows.groupBy(stage).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"), F.max(value).alias("most"))
    scored = held.withColumn("score", F.col("p95") * 1000 + F.col("most"))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), stage)))


def top_stages(runs: dict[str, DataFrame], stage: str, value: str, k: int) -> DataFrame:
    """(stage, one place column for each run): stages among the first ``k`` of any run."""
    ranked = [rank_stages(df, stage, value).select(stage, "place", F.lit(name).alias("run")) for name, df in runs.items()]
    union = ranked[0]
    for other in ranked[1:]:
        union = union.unionByName(other)
    return union.groupBy(stage).agg(*(F.max(F.when(F.col("run") == n, F.col("place"))).alias(n) for n in runs), F.min("place").alias("best")).where(F.col("best") <= k).drop("best")


def compare(rows: DataFrame, by: str, left: str, right: str, rate: str, tail: str, least_rate: float = 1.05, most_tail: float = 1.15) -> DataFrame:
    """(rate_ratio, tail_ratio, verdict): the rate of profile ``left`` over ``right``'s, the tail of ``right`` over
    ``left``'s, 0 without a positive divisor, and ok or warning. One aggregation, no join."""
    pick = lambda column, name: F.coalesce(F.max(F.when(F.col(by) == name, F.col(column))), F.lit(0.0))
    held = rows.agg(pick(rate, left).alias("lr"), pick(rate, right).alias("rr"), pick(tail, left).alias("lt"), pick(tail, right).alias("rt"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    held = held.select(ratio("lr", "rr").alias("rate_ratio"), ratio("rt", "lt").alias("tail_ratio"))
    return held.withColumn("verdict", F.when((F.col("rate_ratio") >= least_rate) & (F.col("tail_ratio") <= most_tail), "ok").otherwise("warning"))


def weighted_score(rows: DataFrame, dimension: str, score: str, weights: dict[str, float]) -> DataFrame:
    """(score, tier): weighted mean of the dimensions' scores; tiers A from 95, B from 80, C from 60, else D."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col(dimension)), F.lit(0.0))
    held = rows.agg(F.try_divide(F.sum(F.col(score) * weight), F.sum(weight)).alias("score"))
    return held.withColumn("tier", F.when(F.col("score") >= 95, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 60, "C").otherwise("D"))
