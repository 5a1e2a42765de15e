"""Reads of one table: filters, lookups, aggregates, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.types import as_type
from ..sources.schema import TableSchema
from .predicate import Condition, compile_conditions, parse_conditions

SHOWN = 50


@dataclass
class Table:
    """A DataFrame with a schema; ``key`` is the column that stands for ``id`` and orders rows of equal rank."""

    df: DataFrame
    schema: TableSchema
    key: str = "id"

    @classmethod
    def from_dataframe(cls, df: DataFrame, key: str = "id", primary_key: str | None = None) -> Table:
        """A read-only table over any DataFrame; no log is needed."""
        schema = TableSchema.of(df.schema, "id" if key == "id" else "")
        schema.primary_key = primary_key or key
        return cls(df, schema, key)

    def condition(self, conditions: str | list[Condition] | list[str] | None) -> Column:
        if conditions is None or len(conditions) == 0:
            return F.lit(True)
        parsed = conditions if isinstance(conditions, list) and isinstance(conditions[0], Condition) else parse_conditions(conditions)
        return compile_conditions(parsed, self.schema, self.df.schema)

    def _typed(self, attribute: str, numeric: bool = True) -> Column:
        if attribute not in self.df.columns:
            raise InvalidArgument(f"unknown attribute {attribute!r}")
        if numeric and not self.schema.is_numeric(attribute):
            raise InvalidArgument(f"{attribute} is not numeric")
        return as_type(F.col(f"`{attribute}`"), self.schema.kind(attribute), self.df.schema[attribute].dataType)

    # filters and lookups

    def where(self, conditions) -> DataFrame:
        """All matching rows; displays show the first 50."""
        return self.df.where(self.condition(conditions))

    def find(self, value: int) -> DataFrame:
        return self.df.where(F.col(f"`{self.key}`") == value)

    def find_pk(self, value: str) -> DataFrame:
        """The row whose primary key, as text, equals ``value``; with ties the one with the smallest key column."""
        hit = self.df.where(F.col(f"`{self.schema.primary_key}`").cast("string") == value)
        return hit.orderBy(F.col(f"`{self.key}`")).limit(1)

    def project(self, attribute: str, key: str, value: str, limit: int | None = SHOWN) -> DataFrame:
        """(id, attribute) of the rows whose ``key``, as text, equals ``value``: the first 50 by id."""
        if key == self.key:
            raise InvalidArgument("the condition can't be on the id")
        hit = self.df.where(F.col(f"`{key}`").cast("string") == value).select(F.col(f"`{self.key}`"), F.col(f"`{attribute}`"))
        return hit if limit is None else hit.orderBy(self.key).limit(limit)

    def balance_hits(self, least: float, attribute: str | None = None) -> DataFrame:
        """Rows whose attribute (by default the table's numeric one) is at least ``least``; text that isn't a number never is."""
        return self.df.where(self._typed(attribute or self.schema.numeric_attribute() or "balance") >= least)

    def balance_summary(self, least: float, attribute: str | None = None) -> DataFrame:
        name = attribute or self.schema.numeric_attribute() or "balance"
        typed = self._typed(name)
        return self.balance_hits(least, name).agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.sum(typed), F.lit(0)).alias("total"))

    # aggregates, all of them one pass with partial aggregation

    def count(self, conditions=None) -> DataFrame:
        """(matched, total), or (total) without a condition."""
        if not conditions:
            return self.df.agg(F.count(F.lit(1)).alias("total"))
        return self.df.agg(F.count_if(self.condition(conditions)).alias("matched"), F.count(F.lit(1)).alias("total"))

    def sum(self, attribute: str, conditions=None) -> DataFrame:
        """The sum of what can be read as a number, 0 if nothing can."""
        typed = self._typed(attribute)
        return self.where(conditions).agg(F.coalesce(F.sum(typed), F.lit(0).cast("long" if self.schema.kind(attribute) == "int" else "double")).alias("value"))

    def avg(self, attribute: str, conditions=None) -> DataFrame:
        return self.where(conditions).agg(F.avg(self._typed(attribute)).alias("value"))

    def min(self, attribute: str, conditions=None) -> DataFrame:
        return self.where(conditions).agg(F.min(self._typed(attribute)).alias("value"))

    def max(self, attribute: str, conditions=None) -> DataFrame:
        return self.where(conditions).agg(F.max(self._typed(attribute)).alias("value"))

    def covering(self, key: str, attribute: str) -> DataFrame:
        """Count and sum of ``attribute`` for each value of ``key``: what answers equality aggregates without a scan."""
        return self.df.groupBy(F.col(f"`{key}`")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(self._typed(attribute)), F.lit(0)).alias("total"))

    # order and pages

    def _order(self, attribute: str, descending: bool) -> list[Column]:
        if attribute not in self.df.columns:
            raise InvalidArgument(f"unknown attribute {attribute!r}")
        column = self._typed(attribute, numeric=False)
        return [column.desc_nulls_last() if descending else column.asc_nulls_first(), F.col(f"`{self.key}`").asc()]

    def page(self, number: int, size: int, order: str | None = None, descending: bool = False) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows; rows of equal rank come by ascending key in both directions."""
        if number < 1 or size < 1:
            raise InvalidArgument("page and size start at 1")
        return self.df.orderBy(*self._order(order or self.key, descending)).offset((number - 1) * size).limit(size)

    def page_after(self, after: int, size: int, descending: bool = False) -> DataFrame:
        """The ``size`` rows that follow key ``after``: a filter and a top-k, whatever the depth of the page."""
        key = F.col(f"`{self.key}`")
        return self.df.where(key < after if descending else key > after).orderBy(key.desc() if descending else key.asc()).limit(size)

    def dense_ids(self) -> DataFrame:
        """(old_id, new_id): ids renumbered from 1 in their order.

        Ranges are numbered by one window each and shifted by the count of those before, so no task holds all rows.
        """
        ids = self.df.select(F.col(f"`{self.key}`").cast("long").alias("old_id"))
        bounds = ids.agg(F.percentile_approx("old_id", [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
        bounds = sorted(set(bounds))
        part = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b < F.col("old_id"))) if bounds else F.lit(0)
        placed = ids.withColumn("part", part)
        sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 64 rows
        shift, done = [], 0
        for p in sorted(sizes):
            shift += [F.lit(p), F.lit(done)]
            done += sizes[p]
        numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("old_id")))
        offset = F.element_at(F.create_map(*shift), F.col("part")) if shift else F.lit(0)
        return numbered.select("old_id", (F.col("at") + offset).cast("long").alias("new_id"))
