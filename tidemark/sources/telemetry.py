"""Runtime-statistics rows in JSON lines: reading, selecting and validating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(counters: list[str]) -> T.StructType:
    stats = T.StructType([T.StructField(c, T.DoubleType()) for c in counters])
    return T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("stats", stats), T.StructField("_bad", T.StringType())])


def read(spark: SparkSession, path: str, counters: list[str]) -> DataFrame:
    """Rows of one object a line with an explicit schema; lines that aren't objects are kept in ``_bad``."""
    return spark.read.json(path, schema=schema(counters), columnNameOfCorruptRecord="_bad", mode="PERMISSIVE")


def pick(rows: DataFrame, run_id: str | None = None, label_prefix: str | None = None, last: int | None = None) -> DataFrame:
    """Rows of a run and of labels with a prefix; ``last`` keeps the newest ones by time."""
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if label_prefix is not None:
        rows = rows.where(F.col("label").startswith(label_prefix))
    return rows if last is None else rows.orderBy(F.desc("ts_ms")).limit(last)


def with_defaults(rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Rows of older writers with the counters that they didn't have yet: a missing one takes its default."""
    stats = F.col("stats")
    for name, value in defaults.items():
        stats = stats.withField(name, F.coalesce(F.col(f"stats.{name}"), F.lit(float(value))))
    return rows.withColumn("stats", F.when(F.col("stats").isNotNull(), stats))


def violations(rows: DataFrame, version: str, required: list[str]) -> DataFrame:
    """Each bad row with ``problems``: unreadable, of another version, without time, run or label, or with a required
    counter that is missing, negative or not whole."""
    problems = [
        F.when(F.col("_bad").isNotNull(), F.lit("unreadable")),
        F.when(~F.col("schema_version").eqNullSafe(version), F.lit("schema_version")),
        F.when(F.col("ts_ms").isNull() | (F.col("ts_ms") < 0), F.lit("ts_ms")),
        *(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("run_id", "label")),
        *(F.when(F.col(f"stats.{c}").isNull() | (F.col(f"stats.{c}") < 0) | (F.col(f"stats.{c}") != F.floor(f"stats.{c}")), F.lit(f"stats.{c}")) for c in required),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*problems))).where("size(problems) > 0")
