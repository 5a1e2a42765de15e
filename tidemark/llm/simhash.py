"""SimHash near-duplicates: fingerprints linked through Golay-code keys.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). Two fingerprints that differ in at most two
bits agree exactly in one segment (pigeonhole), and in the following segment they differ in at most two bits. Each
segment is a word of the shortened perfect [23, 12, 7] Golay code: every 23-bit word lies within three bits of just
one codeword. The codewords nearest to a segment and to its one-bit neighbours are its keys (one to six or seven); two
segments at most two bits apart have a common one-bit neighbour, hence a common key. So (segment number, its exact
bits, a codeword index of the next segment) is a key that every pair to be linked has in common.

Buckets of up to ``BUCKET`` fingerprints are compared directly. Members of larger ones are linked through the points
midway: two fingerprints at most two bits apart both lie within one bit of some 64-bit word, and no word has more
than 65 such neighbours, so that way is exact, has bounded groups and emits no pairs of a large group.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, without
from .components import components

#: The generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1, and the segments (shift, width).
GOLAY_POLYNOMIAL = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of one bucket that are compared one by one.
BUCKET = 32
#: Shingles held at once while the bits of one text are counted.
CHUNK = 1 << 16


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """For each 23-bit word the index of its nearest codeword (16 MB, made in a fraction of a second)."""
    codewords = np.zeros(1 << 12, np.uint32)
    for bit in range(12):
        codewords[1 << bit : 2 << bit] = codewords[: 1 << bit] ^ np.uint32(GOLAY_POLYNOMIAL << bit)
    table = np.zeros(1 << 23, np.uint16)
    ones = [1 << i for i in range(23)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])]
    index = np.arange(1 << 12, dtype=np.uint16)
    for e in errors:
        table[codewords ^ np.uint32(e)] = index
    return table


def golay_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and its one-bit neighbours within ``width`` bits, shape (n, width + 1)."""
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    return golay_index()[words[:, None] ^ flips]


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of all distinct keys of unsigned 64-bit fingerprints."""
    where, keys = [], []
    parts = [((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    for s in range(3):
        other = (s + 1) % 3
        near = np.sort(golay_keys(parts[other], SEGMENTS[other][1]).astype(np.int64), axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        where.append(row)
        keys.append((np.int64(s) << 34) | (parts[s][row] << 12) | near[row, col])
    return np.concatenate(where), np.concatenate(keys)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text; 0 for null and for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, counts, digest = len(words) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, print): the fingerprint of each row's whole text as a signed long; rows and null ids are kept as they are."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "print"])

    return map_arrow(rows, run, "id long, print long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                where, keys = bucket_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[where])], ["key", "print"])

    return map_arrow(prints.select("print"), run, "key long, print long")


def links(prints: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among distinct fingerprints ``print`` that differ in at most ``bits`` (0, 1 or 2) bits.

    Not every such pair is a row, but any two fingerprints at most ``bits`` apart are joined by rows.
    """
    if bits not in (0, 1, 2):
        raise ValueError("Golay keys find up to two differing bits")
    keyed = materialise(_keyed(prints))
    size = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    held = keyed.join(size, "key")
    near = lambda p: (p["a"] < p["b"]) & (F.bit_count(p["a"].bitwiseXOR(p["b"])) <= bits)
    pairs = F.flatten(F.transform("prints", lambda a: F.transform("prints", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    small = held.where(F.col("size") <= bucket).groupBy("key").agg(F.collect_list("print").alias("prints")).select(F.explode(F.filter(pairs, near)).alias("p")).select("p.a", "p.b")
    crowded = held.where(F.col("size") > bucket).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)))
    mid = crowded.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("mid"), (F.col("flip") == 0).alias("itself"))
    if bits == 1:  # only the word itself stands midway to its neighbours
        group = mid.groupBy("mid").agg(F.collect_list("print").alias("prints"), F.max("itself").alias("real")).where("real").select(F.col("mid").alias("a"), F.explode("prints").alias("b"))
    else:
        group = mid.groupBy("mid").agg(F.min("print").alias("a"), F.collect_list("print").alias("prints")).where("size(prints) > 1").select("a", F.explode("prints").alias("b"))
    return small if bits == 0 else small.unionByName(group.where("a != b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """(id, print, component): each row with its fingerprint and the smallest id reachable over linked fingerprints.

    Null and empty texts and texts without words have fingerprint 0 and are linked like any other. Repeated rows stay
    repeated. A null id is never a component's id unless the component has no other (then it is null). Columns other
    than the two named are not read, whatever their names. An empty table gives an empty table.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, seed))
    classes = materialise(rows.groupBy("print").agg(F.min("id").alias("low")))
    roots = components(links(classes, bits)).withColumnRenamed("node", "print")
    named = classes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    labelled = materialise(named.join(lowest, "root").select("print", "component"))  # so that both sides of the join are shuffled and a hot print can be split
    return rows.join(labelled, "print").select("id", "print", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows with a null id can't be named and stay.

    Rows that repeat an id count as one document and stay or go together. All columns are kept.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    return without(docs, found.where("id != component").select("id"), id_col)
