"""The version log of a table: Parquet commits, published by manifests.

Every statement writes whole new rows, or tombstones, to a folder of its own with one ``_seq``; a manifest that is
renamed into place publishes it. The current rows are the newest of each id without a tombstone. A manifest names one
compacted base, whose ids are unique, and the folders after it: only those are searched for the newest row of an id,
and base rows with newer versions are taken out by an anti join. So a table without recent writes is a plain scan.

A manifest also holds the schema of its folders: attributes change only together with a new base, so one publication
changes both, and an earlier state is read by the schema it was written with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, NotFound
from .files import Store
from .schema import TableSchema

HIDDEN = ("_seq", "_deleted")


class Log:
    """One table's folder: ``schema.json``, ``data/<folder>`` and ``manifest/<number>.json``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # metadata

    def create(self, schema: TableSchema) -> Log:
        if self.store.exists("schema.json"):
            raise Conflict("the table exists")
        self.store.make("data")
        self.store.make("manifest")
        self.store.write("schema.json", schema.to_json())
        return self

    def schema(self, manifest: dict | None = None) -> TableSchema:
        """The schema of a manifest, by default the newest; of a table without commits that it was created with."""
        if not self.store.exists("schema.json"):
            raise NotFound("no such table")
        held = (manifest or self.manifest()).get("schema")
        return TableSchema.from_json(held or self.store.read("schema.json"))

    def set_schema(self, schema: TableSchema) -> None:
        """Change key or label, or, before the first commit, anything. Attributes of written rows change by ``replace``."""
        before = self.manifest()
        if before["version"]:
            self.publish(before, [], schema=schema)
        else:
            self.store.write("schema.json", schema.to_json())

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first commit."""
        held = self.versions()
        if not held:
            return {"version": 0, "seq": 0, "base": None, "base_seq": 0, "deltas": [], "ts_ms": 0, "schema": None}
        return json.loads(self.store.read(f"manifest/{version or max(held):08d}.json"))

    # reading

    def _struct(self, schema: TableSchema) -> T.StructType:
        return T.StructType([*schema.struct().fields, T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def _read(self, folders: list[str], schema: TableSchema) -> DataFrame:
        struct = self._struct(schema)
        if not folders:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self.store.root}/data/{f}" for f in folders))

    def history(self, manifest: dict | None = None, schema: TableSchema | None = None, staged: list[tuple[str, int]] = ()) -> DataFrame:
        """Every version, tombstones included, with ``_seq`` and ``_deleted``."""
        manifest = manifest or self.manifest()
        schema = schema or self.schema(manifest)
        return self._read([*([manifest["base"]] if manifest["base"] else []), *(f for f, _ in manifest["deltas"]), *(f for f, _ in staged)], schema)

    def current(self, seq: int | None = None, manifest: dict | None = None, schema: TableSchema | None = None, staged: list[tuple[str, int]] = (), shift: int = 0) -> DataFrame:
        """The rows as of ``seq`` (now, if None), with a transaction's staged folders on top.

        ``shift`` is added to the sequence numbers of staged rows, so that they stay above what others have published
        since the transaction began. An earlier state has its own schema.
        """
        manifest = manifest or self.manifest()
        if seq is not None and seq < manifest["base_seq"]:
            manifest, schema = self._manifest_at(seq), None
        schema = schema or self.schema(manifest)
        deltas = [f for f, s in manifest["deltas"] if seq is None or s <= seq]
        own = [f for f, s in staged if seq is None or s + shift <= seq]
        base = self._read([manifest["base"]] if manifest["base"] else [], schema)
        columns = ["id", *schema.names]
        if not deltas and not own:
            return base.select(*columns)
        newer = latest(self._read(deltas, schema).unionByName(self._read(own, schema).withColumn("_seq", F.col("_seq") + shift)) if own else self._read(deltas, schema))
        kept = newer.where(~F.col("_deleted")).select(*columns)
        if not manifest["base"]:
            return kept
        return base.join(newer.select("id"), "id", "left_anti").select(*columns).unionByName(kept)

    def _manifest_at(self, seq: int) -> dict:
        """The newest manifest whose base is not younger than ``seq``."""
        for version in sorted(self.versions(), reverse=True):
            held = self.manifest(version)
            if held["base_seq"] <= seq:
                return held
        raise NotFound("that state is no longer kept")

    def seq_at(self, ts_ms: int) -> int:
        """The last sequence number published at or before a time."""
        return max([0, *(m["seq"] for m in map(self.manifest, self.versions()) if m["ts_ms"] <= ts_ms)])

    # writing

    def stage(self, rows: DataFrame, schema: TableSchema, seq: int, deleted: bool = False) -> str:
        """Write rows (id and attributes) or, of their ids, tombstones to a new folder that nothing names yet."""
        folder = f"s{seq:08d}-{uuid.uuid4().hex[:12]}"
        shaped = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.struct().fields))
        shaped.withColumns({"_seq": F.lit(seq).cast("long"), "_deleted": F.lit(deleted)}).write.parquet(f"{self.store.root}/data/{folder}")
        return folder

    def publish(self, before: dict, folders: list[tuple[str, int]], base: str | None = None, base_seq: int | None = None, schema: TableSchema | None = None) -> dict:
        """Make folders part of the table, with the schema if it changes; a manifest published since ``before`` is a Conflict."""
        seq = max([before["seq"], *(s for _, s in folders)])
        new = {"version": before["version"] + 1, "seq": seq, "base": before["base"], "base_seq": before["base_seq"], "deltas": [*before["deltas"], *folders], "ts_ms": int(time.time() * 1000), "schema": (schema or self.schema(before)).to_json()}
        if base_seq is not None:
            new |= {"base": base, "base_seq": base_seq, "deltas": []}
        self.store.write(f"manifest/{new['version']:08d}.json", json.dumps(new), overwrite=False)
        return new

    def append(self, rows: DataFrame, deleted: bool = False) -> dict:
        """One statement of its own: stage and publish."""
        before = self.manifest()
        seq = before["seq"] + 1
        return self.publish(before, [(self.stage(rows, self.schema(), seq, deleted), seq)])

    def replace(self, rows: DataFrame, schema: TableSchema | None = None) -> dict:
        """Make ``rows`` the whole table, as a new base."""
        before, schema = self.manifest(), schema or self.schema()
        seq = before["seq"] + 1
        folder = self.stage(rows, schema, seq)
        return self.publish(before | {"seq": seq}, [], folder, seq, schema)

    def compact(self) -> dict:
        """Rewrite the current rows as a new base; older versions stay readable by their manifests."""
        return self.replace(self.current())

    def recover(self, seq: int) -> dict:
        """Publish the state as of ``seq``, with its schema, as the newest one."""
        manifest = self.manifest()
        at = self._manifest_at(seq) if seq < manifest["base_seq"] else manifest
        schema = self.schema(at)
        return self.replace(self.current(seq, at, schema), schema)

    def size(self) -> int:
        """Bytes of the files that the newest manifest names."""
        manifest = self.manifest()
        folders = [*([manifest["base"]] if manifest["base"] else []), *(f for f, _ in manifest["deltas"])]
        return sum(self.store.size(f"data/{f}") for f in folders)

    def sweep(self, older_ms: int = 3_600_000) -> list[str]:
        """Delete folders that no manifest names and that are older than an hour, by default: what crashed statements
        and lost transactions left. Gives their names."""
        named = {f for v in self.versions() for m in [self.manifest(v)] for f in [m["base"], *(f for f, _ in m["deltas"])] if f}
        limit = int(time.time() * 1000) - older_ms
        gone = [n for n in self.store.names("data", folders=True) if n not in named and self.store.modified(f"data/{n}") <= limit]
        for name in gone:
            self.store.delete(f"data/{name}")
        return gone


def latest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest version of each id, tombstones included: one row an id by a pre-aggregated maximum.

    Where columns are wide the struct travels with the maximum; no id's versions are ever sorted together.
    """
    rows = log if seq is None else log.where(F.col("_seq") <= seq)
    others = [c for c in rows.columns if c not in ("id", "_seq")]
    held = rows.groupBy("id").agg(F.max_by(F.struct(*others), "_seq").alias("row"), F.max("_seq").alias("_seq"))
    return held.select("id", *(F.col(f"row.`{c}`").alias(c) for c in others), "_seq").select(*rows.columns)
