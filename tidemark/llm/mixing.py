"""Mixing sources to target weights: repetition rates per source and hash-seeded copies, in DataFrame functions only.

A document is taken floor(rate) times and once more with the fraction of its source's rate as probability. The draws
of that copy are spread evenly: documents of a source stand in order of size, and a hash-seeded start and steps of the
fraction tell which ones get it. Each has just that probability, but a source's words come much nearer to the target
than by independent draws. Sources are cut by a hash into strata of about ``STRATUM`` documents, so none is ordered
in one task.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)
MOST = 3
STRATUM = 4096
#: The table of sources is broadcast up to this size.
SMALL_ROWS, SMALL_BYTES = 10_000, 1 << 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, documents, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by them. A target
    stops at ``most`` times the source's size and what is above is shared again by weight: in the order of size over
    weight a first run of sources is held at its limit, and the others share what is left. One row per source.
    """
    scale = lcm(*weights)
    cyclic = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")).withColumn("at", F.row_number().over(by_name))
    held = held.withColumn("weight", cyclic(weights).cast("long")).withColumn("key", F.col("source_size").cast("decimal(38,0)") * cyclic([scale // w for w in weights]))
    before = Window.orderBy("key", "at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    held = held.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    fits = most * exact("source_size") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (exact("total") - most * exact("size_before"))
    held = held.withColumn("full", F.min(fits).over(upto))
    held = held.withColumns({"full_size": F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything), "full_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything)})
    left = F.col("weight") * (F.col("total") - most * F.col("full_size"))
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(left.cast("double") / (F.col("all_weight") - F.col("full_weight")).cast("double"))
    return held.select("source", "source_size", "documents", target.alias("target"))


def draw(key: Column, first: int = 1) -> Column:
    """A number in [0, 1) from eight hex digits of a key's MD5, the first ones or those from another place."""
    return F.conv(F.substring(F.md5(key), first, 8), 16, 10).cast("double") / float(1 << 32)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    """What the copies of a row depend on: its source, size and hashed key."""
    text, key = docs[text_col].cast("string"), docs[id_col].cast("string")
    key = F.concat(F.coalesce(key, F.md5(text), F.lit("")), F.lit(f":{seed}"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return {"__source": docs[source_col].cast("string"), "__size": size, "__draw": draw(key), "__place": draw(key, 9)}


def _taken(rows: DataFrame, goal: DataFrame, seed: str) -> DataFrame:
    """``rows`` with the columns of ``_drawn``, ``goal`` and ``__copies``."""
    goal = goal.select(F.col("source").alias("__of"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "documents", "target")))
    n, letters = goal.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__of")), F.lit(0))).first()
    if n <= SMALL_ROWS and letters <= SMALL_BYTES:  # else a shuffled join, whose hot sources adaptive execution splits
        goal = F.broadcast(goal)
    joined = rows.join(goal, F.col("__source").eqNullSafe(F.col("__of")))
    rate = F.coalesce(F.try_divide(F.col("__target"), F.col("__source_size").cast("double")), F.lit(0.0))
    joined = joined.withColumns({"__rate": rate, "__stratum": F.floor(F.col("__place") * F.ceil(F.col("__documents") / STRATUM))})
    start = draw(F.concat(F.coalesce("__source", F.lit("")), F.lit(":"), F.col("__stratum").cast("string"), F.lit(f":{seed}")))
    order = Window.partitionBy("__source", "__stratum").orderBy(F.desc("__size"), "__draw", "__place")
    fraction, at = F.col("__rate") - F.floor("__rate"), F.col("__at")
    joined = joined.repartition("__source", "__stratum").withColumns({"__at": F.row_number().over(order), "__start": start})
    return joined.withColumn("__copies", F.floor("__rate") + F.floor(fraction * at + F.col("__start")) - F.floor(fraction * (at - 1) + F.col("__start")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(id, size, source_size, target, copies): how often the mix takes each row.

    The rate of a source is its target over its size. Draws hang on ids (on texts where the id is null), sizes and
    sources alone, so reruns agree. Repeated rows are rows like any other. Size counts words; null texts have none. A
    source without words has target 0 and no copies. The words are counted once, in a table of small rows in the
    shared folder.
    """
    rows = materialise(docs.select(docs[id_col].alias("id"), *(c.alias(n) for n, c in _drawn(docs, id_col, text_col, source_col, seed).items())))
    goal = materialise(targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, most))
    return _taken(rows, goal, seed).select("id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated as often as ``copies`` says, all columns kept, whatever their names.

    Null texts have no words, and null sources are a source of their own, the last. Repeated rows are rows like any
    other; documents of one size stand in the order of their hashed ids, equal ids in any. An empty table gives an
    empty one.
    """
    drawn = _drawn(docs, id_col, text_col, source_col, seed)
    goal = materialise(targets(docs.select(drawn["__source"].alias("source"), drawn["__size"].alias("size")), weights, most))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in drawn.items()))  # so that no name of the caller's meets one of ours
    taken = _taken(rows, goal, seed).where("__copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select("row.*")


#: The query's rows in DuckDB.
COPIES_SQL = """
WITH k AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '') || ':mix') AS key FROM documents),
d AS (SELECT doc_id, source, size, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS draw,
    CAST(('0x' || substr(key, 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS place FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
        source_size * CASE (rn - 1) % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 10 END AS ratio FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
        coalesce(sum(source_size) OVER b, 0) AS size_before, coalesce(sum(weight) OVER b, 0) AS weight_before
      FROM w WINDOW b AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN 3 * source_size::HUGEINT * (all_weight - weight_before) <= weight * (total - 3 * size_before) THEN 1 ELSE 0 END)
        OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM r),
g AS (SELECT *, sum(is_full * source_size) OVER () AS full_size, sum(is_full * weight) OVER () AS full_weight FROM f),
t AS (SELECT source, source_size, documents, CASE WHEN is_full = 1 THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST(weight * (total - 3 * full_size) AS DOUBLE) / CAST(all_weight - full_weight AS DOUBLE) END AS target FROM g),
j AS (SELECT doc_id, d.source, size, source_size, target, draw, place, coalesce(target / nullif(source_size, 0), 0) AS rate,
        CAST(floor(place * ceil(documents / 4096)) AS BIGINT) AS stratum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, rate - floor(rate) AS fraction, row_number() OVER (PARTITION BY source, stratum ORDER BY size DESC, draw, place) AS row_place,
        CAST(('0x' || substr(md5(coalesce(source, '') || ':' || CAST(stratum AS VARCHAR) || ':mix'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM j)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + floor(fraction * row_place + start) - floor(fraction * (row_place - 1) + start)) AS BIGINT) AS taken FROM o
"""
