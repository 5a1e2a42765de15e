"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import shared_dir

#: One word: a maximal run of anything but ASCII white space (space and 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table of ids that is broadcast.
BROADCAST = 1_000_000
#: Most rows of an Arrow batch, and bytes after which one is passed on.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has, whatever its case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the only column of ``gone``, a long; null ids stay, and all columns."""
    name = unused(docs.columns, "gone")
    return docs.join(by_size(gone.toDF(name).distinct()), docs[id_col].cast("long") == F.col(name), "left_anti")


def by_size(ids: DataFrame) -> DataFrame:
    """A table of one column of longs, run once: broadcast in joins if its rows were counted to be at most ``BROADCAST``
    (some 16 MB as a hash table), else left to a shuffled join."""
    ids = materialise(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def materialise(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, run, schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` for rows with whole texts: batches of at most ``rows`` rows or some ``BATCH_BYTES`` (the session's
    settings are lowered to that), and a worker gives freed memory back at the end of a task, since workers live on and what one stage's keeps
    is missing to the next."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = re.match(r"[0-9]+", conf.get(key, None) or "")
        if held and not 0 < int(held[0]) <= most:
            conf.set(key, str(most))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
                trim(0)

    return df.mapInArrow(wrapped, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_remainder(id_col: F.Column, modulus: int) -> F.Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(texts: pa.Array, limit: int):
    """Cut an array of strings into (start, stop) runs of about ``limit`` characters, at least one string each."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
