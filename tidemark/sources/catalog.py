"""Workspaces: tables in a folder, the namespaces they are labelled with, and databases as folders."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from ..errors import Conflict, InvalidArgument, NotFound
from ..operators.stats import storage_health
from .files import Store
from .log import Log
from .schema import TableSchema

NAMESPACES = "_namespaces.json"
DATABASE = "_database.json"


def checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name or ""):
        raise InvalidArgument(f"bad name {name!r}")
    return name


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, self.root)
        self.store.make("")

    def log(self, name: str) -> Log:
        return Log(self.spark, f"{self.root}/{checked(name)}")

    def has(self, name: str) -> bool:
        return self.store.exists(f"{checked(name)}/schema.json")

    def tables(self) -> list[str]:
        return [n for n in self.store.names("", folders=True) if self.store.exists(f"{n}/schema.json")]

    def create(self, name: str, schema: TableSchema | None = None) -> Log:
        return self.log(name).create(schema or TableSchema())

    def drop(self, name: str) -> None:
        if not self.has(name):
            raise NotFound(f"no table {name}")
        self.store.delete(name)

    def rename(self, old: str, new: str) -> None:
        if not self.has(old):
            raise NotFound(f"no table {old}")
        if self.store.exists(checked(new)):
            raise Conflict(f"{new} exists")
        self.store.rename(old, new)

    def import_folder(self, path: str) -> dict[str, str]:
        """Copy the tables of another workspace that this one lacks; names ending in ``_log`` are left out."""
        other, out = Workspace(self.spark, path), {}
        for name in other.tables():
            if name.endswith("_log") or self.store.exists(name):
                out[name] = "skipped"
                continue
            try:
                self.store.copy(f"{other.root}/{name}", name)
                out[name] = "imported"
            except Exception as error:  # noqa: BLE001  a report on each table, whatever failed
                out[name] = f"failed: {error}"
        return out

    def vacuum_queue(self) -> list[tuple[str, float]]:
        """Tables with their share of dead versions, the worst first: the order to compact them in.

        Only tables with commits since their last compaction are looked into; the others have no dead versions.
        """
        logs = {t: self.log(t) for t in self.tables()}
        health = {t: storage_health(log.history()).first()["dead_ratio"] if log.manifest()["deltas"] else 0.0 for t, log in logs.items()}
        return sorted(health.items(), key=lambda x: (-x[1], x[0]))

    def run_vacuum(self, least: float = 0.2, most: int = 8) -> list[str]:
        """Compact up to ``most`` tables of the queue whose share of dead versions is at least ``least``."""
        done = [t for t, share in self.vacuum_queue() if share >= least][:most]
        for name in done:
            self.log(name).compact()
            self.log(name).sweep()
        return done

    # namespaces

    def _known(self) -> list[str]:
        return json.loads(self.store.read(NAMESPACES)) if self.store.exists(NAMESPACES) else []

    def namespaces(self) -> dict[str, int]:
        """Namespaces with the number of their tables."""
        labels = [self.log(t).schema().label for t in self.tables()]
        return {n: labels.count(n) for n in sorted({*self._known(), *filter(None, labels)})}

    def create_namespace(self, name: str) -> None:
        if checked(name) in self.namespaces():
            raise Conflict(f"{name} exists")
        self.store.write(NAMESPACES, json.dumps(sorted([*self._known(), name])))

    def drop_namespace(self, name: str) -> None:
        held = self.namespaces()
        if name not in held:
            raise NotFound(f"no namespace {name}")
        if held[name]:
            raise Conflict(f"{name} has tables")
        self.store.write(NAMESPACES, json.dumps([n for n in self._known() if n != name]))

    def label(self, table: str, namespace: str) -> None:
        log = self.log(table)
        schema = log.schema()
        if namespace and namespace not in self.namespaces():
            raise NotFound(f"no namespace {namespace}")
        schema.label = namespace
        log.set_schema(schema)

    # databases

    def create_database(self, name: str) -> Workspace:
        if self.store.exists(f"{checked(name)}/{DATABASE}"):
            raise Conflict(f"{name} exists")
        self.store.make(name)
        self.store.write(f"{name}/{DATABASE}", json.dumps({"name": name}))
        return Workspace(self.spark, f"{self.root}/{name}")

    def databases(self) -> list[str]:
        return [n for n in self.store.names("", folders=True) if self.store.exists(f"{n}/{DATABASE}")]

    def database(self, name: str) -> Workspace:
        if name not in self.databases():
            raise NotFound(f"no database {name}")
        return Workspace(self.spark, f"{self.root}/{name}")

    def drop_database(self, name: str) -> None:
        self.database(name)
        self.store.delete(name)
