"""Statistics of columns, selectivities from them, and the health of a version log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_dir
from ..sources.schema import TableSchema

BUCKETS, TOP = 8, 3
#: Shares of rows that a condition keeps when nothing is known of the data.
BLIND = {"id=": 0.0001, "=": 0.08, "contains": 0.35, "range": 0.45, "!=": 0.45}


def _text(column: str):
    return F.col(f"`{column}`").cast("string").alias("value")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """(non_null, distinct_values, min_text, max_text): one aggregation; the order is that of the text."""
    return df.select(_text(column)).agg(F.count("value").alias("non_null"), F.countDistinct("value").alias("distinct_values"), F.min("value").alias("min_text"), F.max("value").alias("max_text"))


def column_top(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """(value, n): the most frequent values, ties by ascending value."""
    return df.select(_text(column)).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def running_total(counts: DataFrame, order: str, weight: str) -> DataFrame:
    """``counts`` with ``upto``, the sum of ``weight`` over the rows up to this one by ``order``, and ``total``.

    Rows are cut into ranges of ``order``; each range adds up its own, and the sums of those before it, one number for a
    range, come by way of the driver. So no task holds the whole order.
    """
    shared_dir(counts.sparkSession)
    placed = counts.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = {r["part"]: r["s"] for r in placed.groupBy("part").agg(F.sum(weight).alias("s")).collect()}
    before, done = [], 0
    for part in sorted(sums):
        before += [F.lit(part), F.lit(done).cast("long")]
        done += sums[part]
    shift = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0).cast("long")
    own = F.sum(weight).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumns({"upto": own + shift, "total": F.lit(done).cast("long")}).drop("part")


def column_histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, low, high): equi-depth, position i of n falls in ``floor(i * buckets / n)``.

    Equal values are counted first; a value's run of positions is then cut into buckets by arithmetic, so that a
    frequent value is one row, and the distinct values are ordered range by range.
    """
    counts = df.select(_text(column)).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    placed = running_total(counts, "value", "c").withColumn("from", F.col("upto") - F.col("c"))
    first = F.floor(F.col("from") * buckets / F.col("total"))
    last = F.floor((F.col("upto") - 1) * buckets / F.col("total"))
    cut = placed.withColumn("bucket", F.explode(F.sequence(first, last)))
    edge = lambda b: F.ceil(b * F.col("total") / buckets)
    held = F.least(F.col("upto"), edge(F.col("bucket") + 1)) - F.greatest(F.col("from"), edge(F.col("bucket")))
    return cut.groupBy("bucket").agg(F.sum(held).cast("long").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def equal_selectivity(distinct_values: int) -> float:
    return 1.0 / max(1, distinct_values)


def range_selectivity(distinct_values: int) -> float:
    equal = equal_selectivity(distinct_values)
    return min(0.5, max(4 * equal, equal**0.5))


def selectivity(operator: str, distinct_values: int) -> float:
    """Share of rows that a condition keeps, from the number of distinct values."""
    equal = equal_selectivity(distinct_values)
    if operator == "=":
        return equal
    if operator == "!=":
        return min(0.49, max(0.05, 1.0 - 0.95 * equal))
    if operator == "contains":
        return min(0.45, max(0.08, equal**0.5))
    return range_selectivity(distinct_values)


def blind_estimate(rows: int, conditions) -> float:
    """Rows that a condition list keeps by fixed factors: AND multiplies, OR adds; from one row to all."""
    share = 1.0
    for i, c in enumerate(conditions):
        one = BLIND["id="] if c.operator == "=" and c.attribute == "id" else BLIND.get(c.operator, BLIND["range"])
        share = one if i == 0 else share * one if c.link == "AND" else min(1.0, share + one)
    return min(float(rows), max(1.0, rows * share))


def storage_health(log: DataFrame) -> DataFrame:
    """(versions, tombstones, live, tombstone_ratio, dead_ratio) of a version log with id, _seq and _deleted."""
    last = log.groupBy("id").agg(F.max_by("_deleted", "_seq").alias("gone"), F.count(F.lit(1)).alias("n"), F.count_if("_deleted").alias("t"))
    whole = last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.coalesce(F.sum("t"), F.lit(0)).alias("tombstones"), F.count_if(~F.col("gone")).alias("live"))
    ratio = lambda part: F.coalesce(F.try_divide(part.cast("double"), F.col("versions").cast("double")), F.lit(0.0))
    return whole.select("versions", "tombstones", "live", ratio(F.col("tombstones")).alias("tombstone_ratio"), ratio(F.col("versions") - F.col("live")).alias("dead_ratio"))


def with_bytes(health: DataFrame, size: int) -> DataFrame:
    """``storage_health`` with data_bytes, dead_bytes, live_bytes and fragmentation_ratio of files of ``size`` bytes: the
    share of dead versions, tombstones and superseded ones, is taken for their share of the bytes."""
    dead = F.least(F.lit(size), F.floor(F.lit(float(size)) * F.col("dead_ratio") + 0.5)).cast("long")
    held = health.withColumns({"data_bytes": F.lit(size).cast("long"), "dead_bytes": dead})
    share = F.when(F.col("data_bytes") > 0, F.col("dead_bytes") / F.col("data_bytes")).otherwise(F.col("dead_ratio"))
    return held.withColumns({"live_bytes": F.col("data_bytes") - F.col("dead_bytes"), "fragmentation_ratio": share})


def gather(df: DataFrame, schema: TableSchema) -> dict:
    """Row count and, for each attribute, what ``column_stats`` tells: one pass over the table."""
    names = [n for n in schema.names if n in df.columns]
    columns = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        text = F.col(f"`{n}`").cast("string")
        columns += [F.count(text).alias(f"c{i}"), F.approx_count_distinct(text, 0.02).alias(f"d{i}"), F.min(text).alias(f"l{i}"), F.max(text).alias(f"h{i}")]
    row = df.agg(*columns).first()
    return {"fingerprint": schema.fingerprint(), "rows": row["rows"], "columns": {n: {"non_null": row[f"c{i}"], "distinct": row[f"d{i}"], "min": row[f"l{i}"], "max": row[f"h{i}"]} for i, n in enumerate(names)}}


def is_stale(stats: dict, schema: TableSchema) -> bool:
    return stats.get("fingerprint") != schema.fingerprint()


def to_text(stats: dict) -> str:
    return json.dumps(stats, sort_keys=True)
