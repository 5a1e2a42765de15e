"""Near-duplicates by overlap: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sources, and every one is checked on the whole sets. First, SimHash fingerprints of the shingles
that ``simhash`` links through its Golay keys: all that differ in at most two bits. That finds the closest copies, but at
0.8 some 10 of 64 bits differ, so the rest comes from min-hashes: each set has ``HASHES`` of them, and candidates share one
of ``BANDS`` keys of ``ROWS`` of them each; the keys are made by cutting the min-hashes into parts in several fixed orders.
A pair at 0.8 has no key in common with a probability of about 1e-5, a closer one with less, while texts that merely share
a passage seldom meet: at 0.3 one pair in 230 does. Pairs of a key are first compared by their min-hashes, where a pair at
0.8 fails with a probability of 1e-8. Texts with equal sets are one node. In each bucket of a key the members are compared
with its first one. What this leaves outside a bucket's main component is a query set: each of its rows is compared with all
rows of that component and of the query set, block by block on the whole sets. So each pair of a bucket that isn't in one
component by then is compared, and no pair is skipped; only links leave the blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, map_arrow, materialise, remove, scratch_path, slices, without
from .components import components
from .ngram import tokens
from .simhash import fingerprints, links as golay_links

SHINGLE, HASHES, BANDS, ROWS = 5, 128, 64, 8
#: Equal min-hashes of a pair that is checked on the whole sets: 5.9 deviations below the mean at a similarity of 0.8.
LEAST = 76
#: Characters hashed together, shingles of a block.
TOGETHER, CELL = 1_000_000, 150_000


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the min-hashes, and the min-hashes that make up each key."""
    rng = np.random.default_rng(42)
    top = np.iinfo(np.uint64).max
    orders = np.concatenate([rng.permutation(HASHES) for _ in range(BANDS * ROWS // HASHES)])
    return rng.integers(0, top, HASHES, np.uint64) | np.uint64(1), rng.integers(0, top, HASHES, np.uint64), orders.reshape(BANDS, ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each text's set): distinct shingles in order; a shorter text is one shingle, no words are none."""
    lengths, index, keys = tokens(texts)
    words = _mixed(keys.astype(np.uint64))[index] if len(index) else np.zeros(0, np.uint64)
    begins = np.cumsum(lengths) - lengths
    k = np.minimum(lengths, shingle)
    n = np.where(lengths > 0, lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begins[owner]
    hashes = np.zeros(len(at), np.uint64)
    for j in range(shingle):
        on = j < k[owner]
        hashes[on] = _mixed(hashes[on] * np.uint64(3) + words[at[on] + j] + np.uint64(1))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(n)).astype(np.int64)


def min_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The min-hashes of each set, shape (n, HASHES); sets must not be empty."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), HASHES), np.uint64)
    for i, (a, b) in enumerate(zip(*_constants()[:2], strict=True)):
        out[:, i] = np.minimum.reduceat(hashes * a + b, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """The keys of each row of min-hashes, shape (n, BANDS)."""
    keys = np.empty((len(least), BANDS), np.uint64)
    for band, members in enumerate(_constants()[2].tolist()):
        key = np.full(len(least), band, np.uint64)
        for i in members:
            key = _mixed(key * np.uint64(3) + least[:, i])
        keys[:, band] = key
    return keys


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, print, keys, sketch, text) of each row; ``row`` is unique, ``print`` a digest of the whole set, ``sketch``
    has 16 bits of each min-hash."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                hashes, sizes = shingle_sets(batch.column(1).slice(a, b - a))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                prints = np.fromiter((xxhash.xxh64_intdigest(hashes[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)), np.uint64, b - a)
                full = sizes > 0
                least = min_hashes(hashes, sizes[full]) if full.any() else np.zeros((0, HASHES), np.uint64)
                held = np.concatenate(([0], np.cumsum(full * BANDS)))
                sketch = np.zeros((b - a, HASHES), np.uint16)
                sketch[full] = _mixed(least) >> np.uint64(48)
                sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(prints.view(np.int64)), _lists(held, band_keys(least).reshape(-1)), sketches, batch.column(1).slice(a, b - a)], ["row", "id", "print", "keys", "sketch", "text"])
                row += b - a

    return map_arrow(rows, run, "row long, id long, print long, keys array<long>, sketch binary, text string")


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _sets(texts: DataFrame) -> DataFrame:
    """(row, shingles) of (row, text)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                hashes, sizes = shingle_sets(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(np.concatenate(([0], np.cumsum(sizes))), hashes)], ["row", "shingles"])

    return map_arrow(texts, run, "row long, shingles array<long>")


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) with at least ``LEAST`` equal min-hashes."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= LEAST))

    one = sketches.select(F.col("row").alias("a"), F.col("sketch").alias("left"))
    two = sketches.select(F.col("row").alias("b"), F.col("sketch").alias("right"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right"), run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more: 9 * common >= 4 * (sum of sizes)."""
    one = sets.select(F.col("row").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("row").alias("b"), F.col("shingles").alias("right"))
    m, n, common = F.size("left"), F.size("right"), F.size(F.array_intersect("left", "right"))
    return pairs.join(two, "b").join(one, "a").where((5 * F.least(m, n) >= 4 * F.greatest(m, n)) & (9 * common >= 4 * (m + n))).select("a", "b")


def _links(one: list[np.ndarray], one_roots: list[int], many: list[np.ndarray], many_roots: np.ndarray) -> list[tuple[int, int]]:
    """(place in ``one``, place in ``many``) of sets with a similarity of 0.8 or more and different roots: for each of
    ``one`` a link to each root that has a partner."""
    sizes = np.array([len(x) for x in many])
    values, owner = np.concatenate(many), np.repeat(np.arange(len(many)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner, out = values[order], owner[order], []
    for i, own in enumerate(one):
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = last - first
        hits = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        common = np.bincount(owner[hits], minlength=len(many))
        found = np.flatnonzero((9 * common >= 4 * (sizes + len(own))) & (many_roots != one_roots[i]))
        if len(found):
            out += [(i, int(found[j])) for j in np.unique(many_roots[found], return_index=True)[1]]
    return out


def _against(queries: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of each query (row, crowd, root) with the ``members`` (row, crowd, root) of its crowd.

    Both sides are dealt into blocks of about ``CELL`` shingles, and each block of one meets each of the other's.
    """
    queries, members = materialise(queries), materialise(members)
    blocks = lambda df, name: df.join(sets, "row").groupBy("crowd").agg(F.ceil(F.sum(F.size("shingles")) / CELL).cast("int").alias(name))
    counts = materialise(blocks(queries, "across").join(blocks(members, "down"), "crowd"))
    dealt = lambda own: F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    one = queries.join(counts, "crowd").join(sets, "row").select("crowd", dealt("across").alias("x"), every("down").alias("y"), "row", "root", "shingles")
    two = members.join(counts, "crowd").join(sets, "row").select("crowd", every("across").alias("x"), dealt("down").alias("y"), "row", "root", "shingles")

    def run(left, right):
        rows, roots = ([t.column(i).to_pylist() for t in (left, right)] for i in (3, 4))
        held = [[x.values.to_numpy().view(np.uint64) for x in t.column(5)] for t in (left, right)]
        found = _links(held[0], roots[0], held[1], np.array(roots[1])) if rows[0] and rows[1] else []
        return pa.table({"a": pa.array([rows[0][i] for i, _ in found], pa.int64()), "b": pa.array([rows[1][j] for _, j in found], pa.int64())})

    one, two = (df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns)) for side, df in (("one", one), ("two", two)))
    return one.groupBy("one_crowd", "one_x", "one_y").cogroup(two.groupBy("two_crowd", "two_x", "two_y")).applyInArrow(run, "a long, b long")


def _simhash_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): rows among ``nodes`` (row) whose fingerprints are linked, by the first row of each fingerprint, and the first
    with each other row of its fingerprint; ``texts`` has their texts by row. The sets of a pair need not be alike."""
    prints = materialise(fingerprints(texts, "row", "text", SHINGLE).withColumnRenamed("id", "row").join(nodes, "row", "left_semi"))
    firsts = materialise(prints.groupBy("print").agg(F.min("row").alias("first")))
    found = golay_links(firsts).toDF("print", "other").join(firsts.withColumnRenamed("first", "a"), "print")
    found = found.join(firsts.toDF("other", "b"), "other").select("a", "b")
    return found.unionByName(prints.join(firsts, "print").where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")))


def _roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of linked rows among ``nodes`` (row, keys, sketch); ``texts`` has their texts by row."""
    closest = materialise(_simhash_pairs(by_size(nodes.where("size(keys) > 0").select("row")), texts))
    keyed = nodes.select("row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialise(keyed.join(by_size(shared.select("key")), "key"))
    # The rows that share a key or a fingerprint: only they are looked at from here on.
    near = by_size(held.select("row").unionByName(closest.select(F.explode(F.array("a", "b")).alias("row"))).distinct())
    sketches = materialise(nodes.select("row", "sketch").join(near, "row", "left_semi"))
    sets = materialise(_sets(texts.join(near, "row", "left_semi")))
    leads = held.groupBy("key").agg(F.min("row").alias("a"))
    pairs = materialise(held.join(leads, "key").where("row != a").select("a", F.col("row").alias("b")).distinct())
    links = materialise(_alike(closest.unionByName(_close(pairs, sketches)).distinct(), sets))
    roots = components(links).withColumnRenamed("node", "row")
    live = materialise(held.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")))
    parts = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("crowd"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "crowd")
    live = materialise(live.join(mixed, "key").select("row", "crowd", "root").distinct())
    more = materialise(_against(live.where("root != crowd"), live, sets))
    return components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): each row with the smallest id reachable over documents that overlap by 0.8 or more.

    Texts without words are alike. Null ids and repeated rows are kept; a component has a null id only if no row of it
    has another.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "overlap")
    _sketched(docs, id_col, text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = materialise(rows.groupBy("print").agg(F.min("row").alias("row"), F.min("id").alias("low")))
    nodes = rows.select("row", "keys", "sketch").join(by_size(classes.select("row")), "row", "left_semi")
    roots = _roots(nodes, rows.select("row", "text")).withColumnRenamed("node", "row")
    named = classes.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    labelled = materialise(named.join(lowest, "root").select("print", "component"))
    found = materialise(rows.select("id", "print").join(labelled, "print").select("id", "component"))
    remove(spark, path)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id can't be named and stay.

    Rows that repeat an id count as one document and stay or go together. All columns are kept.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    return without(docs, found.where("id != component").select("id"), id_col)
