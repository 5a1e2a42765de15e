"""Sessions: commands of the form ``VERB(arg, ...)`` on a workspace, with transactions."""

from __future__ import annotations

import datetime as dt
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Conflict, EngineError, InvalidArgument, NotFound, TransactionError
from .functions.types import NUMERIC, SPARK, default, literal, parse, type_name
from .operators import stats
from .operators.predicate import aggregate_arguments, parse_conditions, split_arguments
from .operators.query import SHOWN, Table
from .plans import explain
from .sources import files
from .sources.catalog import Workspace
from .sources.history import History
from .sources.log import Log
from .sources.schema import TableSchema

VERSION = "1.0"
SETTINGS = {"AUTOVACUUM": "300", "WALSYNC": "normal", "WALADAPTIVE": "off", "GROUPCOMMIT": "on", "HOTINDEX": "off", "SEGMENT": "default"}
DEPARTMENTS = ("ENG", "FIN", "OPS", "HR")


@dataclass
class Result:
    """What a command gives: a DataFrame, a text, or both; ``code`` is 0 or an error's code."""

    df: DataFrame | None = None
    text: str = ""
    code: int = 0

    def __str__(self) -> str:
        return self.text if self.df is None else "\n".join(filter(None, [self.text, render(self.df)]))


def render(df: DataFrame, most: int = SHOWN, width: int = 32) -> str:
    """The first rows as a bordered table with cells of at most 32 characters."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(most).collect()]
    rows = [[c if len(c) <= width else c[: width - 3] + "..." for c in r] for r in [df.columns, *rows]]
    sizes = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (n + 2) for n in sizes) + "+"
    line = lambda r: "|" + "|".join(f" {c:<{n}} " for c, n in zip(r, sizes, strict=True)) + "|"
    return "\n".join([rule, line(rows[0]), rule, *map(line, rows[1:]), rule])


@dataclass
class Transaction:
    table: str
    manifest: dict
    staged: list[tuple[str, int]] = field(default_factory=list)
    savepoints: list[tuple[str, int]] = field(default_factory=list)
    ids: set = field(default_factory=set)


class Session:
    def __init__(self, spark: SparkSession, root: str, table: str | None = None):
        self.spark, self.workspace = spark, Workspace(spark, root)
        self.name: str | None = None
        self.txn: Transaction | None = None
        self.isolation, self.on_conflict = "snapshot", ("reject", 0)
        self.settings, self.governor = dict(SETTINGS), explain.Governor()
        self.last_error, self.log_lines = "", []
        self.counters = {"commands": 0, "errors": 0, "commits": 0, "rollbacks": 0, "conflicts": 0, "compactions": 0, "summaries_extended": 0}
        self._schema = TableSchema()
        self.history, self.number = History(self.workspace.store), None
        if table:
            self.set_table(table)

    # programming interface

    def set_table(self, name: str) -> None:
        self._schema = self.workspace.log(name).schema()
        self.name = name

    def keep_history(self, client: str) -> int:
        """Keep this session's commands in the workspace from now on. Gives the session's number there."""
        self.number = self.history.begin(client)
        return self.number

    def execute(self, line: str) -> Result:
        """Run one command. Errors come back as a result with their code, and in ``last_error``."""
        self.counters["commands"] += 1
        self.log_lines.append(line.rstrip("\r\n"))
        if self.number:
            self.history.record(self.number, self.log_lines[-1])
        try:
            return self._dispatch(line.strip())
        except EngineError as error:
            self.counters["errors"] += 1
            self.last_error = str(error)
            return Result(text=f"[{type(error).__name__}] {error}", code=error.code)

    def close(self) -> None:
        """Drop an open transaction and the current table."""
        if self.txn:
            self.rollback(None, [])
        if self.number:
            self.history.end(self.number)
        self.name = self.number = None

    @staticmethod
    def version() -> str:
        return VERSION

    def check_schema(self, name: str) -> TableSchema:
        """The schema of a table, or the error that reading it raises."""
        return self.workspace.log(name).schema()

    def summary(self, key: str, attribute: str) -> DataFrame:
        """Count and sum of an attribute for each value of ``key``, kept beside the table for its sequence number.

        The summary of an earlier state is extended by what the commits since then took away and added, if sums are
        whole numbers and the table wasn't rewritten; else it is built anew. It is never served for a later state.
        """
        if self.txn:
            return self.table().covering(key, attribute)
        log, name = self.log(), f"summary/{key}-{attribute}"
        manifest, store = log.manifest(), log.store
        path = f"{name}/{manifest['seq']}"
        if not store.exists(f"{path}/_SUCCESS"):
            held = [int(n) for n in store.names(name, folders=True) if store.exists(f"{name}/{n}/_SUCCESS")]
            since = max([s for s in held if s >= manifest["base_seq"]], default=None)
            whole = log.schema(manifest).kind(attribute) == "int"
            found = self.table().covering(key, attribute) if since is None or not whole else self._extended(log, manifest, f"{name}/{since}", since, key, attribute)
            found.write.mode("overwrite").parquet(f"{store.root}/{path}")
            self.counters["summaries_extended"] += since is not None and whole
            for old in held:
                store.delete(f"{name}/{old}")
        return self.spark.read.parquet(f"{store.root}/{path}")

    def _extended(self, log: Log, manifest: dict, held: str, since: int, key: str, attribute: str) -> DataFrame:
        """The summary kept in a folder, less the rows as of ``since`` that later commits touch, plus their present ones."""
        schema = log.schema(manifest)
        touched = log._read([f for f, s in manifest["deltas"] if s > since], schema).select("id").distinct()
        parts = self.spark.read.parquet(f"{log.store.root}/{held}")
        for seq, sign in ((since, -1), (None, 1)):
            rows = log.current(seq, manifest).join(touched, "id", "left_semi")
            parts = parts.unionByName(Table(rows, schema).covering(key, attribute).withColumns({"n": F.col("n") * sign, "total": F.col("total") * sign}))
        return parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")

    def runtime_stats(self) -> str:
        return json.dumps(self.counters | {"version": VERSION, "table": self.name, "in_transaction": self.txn is not None}, sort_keys=True)

    def append_snapshot(self, path: str, run_id: str = "", label: str = "") -> None:
        """Append the counters as one row of telemetry to a folder of JSON lines."""
        row = {"schema_version": "runtime_stats.v1", "ts_ms": int(time.time() * 1000), "run_id": run_id, "label": label, "stats": self.counters}
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(path)

    def where_plan_json(self, tokens: list[str] | str) -> str:
        conditions = parse_conditions(tokens)
        table = self.table()
        return explain.show_plan(conditions, table.schema, table.df.count(), table.where(conditions).count(), self._stats(), self._snapshot())

    # state

    def log(self) -> Log:
        if not self.name:
            raise NotFound("no table is in use")
        return self.workspace.log(self.name)

    def _snapshot(self) -> int:
        return (self.txn.manifest if self.txn and self.isolation == "snapshot" else self.log().manifest())["seq"]

    def frame(self) -> DataFrame:
        """Current rows: in a transaction those of its snapshot (or the newest, if read committed) and its own."""
        log = self.log()
        if self.txn and self.txn.table == self.name:
            manifest = self.txn.manifest if self.isolation == "snapshot" else log.manifest()
            return log.current(manifest=manifest, staged=self.txn.staged, shift=manifest["seq"] - self.txn.manifest["seq"])
        return log.current()

    def table(self) -> Table:
        return Table(self.frame(), self.log().schema())

    def _stats(self) -> dict | None:
        log = self.log()
        if not log.store.exists("stats.json"):
            return None
        held = json.loads(log.store.read("stats.json"))
        return None if stats.is_stale(held, log.schema()) or held.get("seq") != log.manifest()["seq"] else held

    def analyze(self) -> dict:
        """Gather and keep the table's statistics."""
        log = self.log()
        held = stats.gather(self.frame(), log.schema()) | {"seq": log.manifest()["seq"]}
        log.store.write("stats.json", stats.to_text(held))
        return held

    # writing

    def _write(self, rows: DataFrame, deleted: bool = False) -> int:
        """One statement's new versions: staged in a transaction, else published at once. Returns the rows written."""
        log, schema = self.log(), self.log().schema()
        if self.txn:
            if self.txn.table != self.name:
                raise TransactionError(f"the transaction is on {self.txn.table}")
            seq = max([self.txn.manifest["seq"], *(s for _, s in self.txn.staged)]) + 1
            folder = log.stage(rows, schema, seq, deleted)
            self.txn.staged.append((folder, seq))
            return log._read([folder], schema).count()
        waited = 0
        while True:
            before = log.manifest()
            seq = before["seq"] + 1
            folder = log.stage(rows, schema, seq, deleted)
            try:
                after = log.publish(before, [(folder, seq)])
                break
            except Conflict:
                self.counters["conflicts"] += 1
                if self.on_conflict[0] != "wait" or waited >= self.on_conflict[1]:
                    raise
                time.sleep(0.05)
                waited += 50
        limit = int(self.settings["AUTOVACUUM"]) if self.settings["AUTOVACUUM"].isdigit() else 0
        if limit and len(after["deltas"]) >= limit:
            log.compact()
            self.counters["compactions"] += 1
        return log._read([folder], schema).count()

    def _check_unique(self, table: Table, attribute: str, value, but: int | None = None) -> None:
        hit = table.df.where(F.col(f"`{attribute}`") == literal(value, table.schema.kind(attribute)))
        if not (hit if but is None else hit.where(F.col("id") != but)).isEmpty():
            raise Conflict(f"{attribute} {value} exists")

    def _values(self, schema: TableSchema, texts: list[str], fill: bool) -> list:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        out = []
        for i, (name, kind) in enumerate(schema.attributes):
            if i < len(texts):
                dated = kind in ("date", "datetime", "timestamp") and texts[i].strip() in ("", "0")
                out.append(default(kind, now) if dated else parse(texts[i], kind, now))
            elif fill:
                out.append(default(kind, now))
            else:
                raise InvalidArgument(f"a value for {name} is missing")
        return out

    def _id(self, text: str) -> int:
        value = parse(text, "int")
        if not 0 < value < 2**31:
            raise InvalidArgument("an id is from 1 to 2147483647")
        return value

    def _row(self, schema: TableSchema, key: int, values: list) -> DataFrame:
        return self.spark.createDataFrame([(key, *values)], schema.struct())

    # commands

    def _dispatch(self, line: str) -> Result:
        if not line or line.startswith("#"):
            return Result()
        head = re.match(r"[A-Za-z_]+(?:\s+[A-Za-z_]+)*", line)
        if not head:
            raise InvalidArgument(f"unknown command {line!r}")
        opened = line.find("(")
        words = (line if opened < 0 else line[:opened]).split()
        inner = None
        if opened >= 0:
            closed = line.rfind(")")
            if closed < opened:
                raise InvalidArgument("a closing bracket is missing")
            inner = line[opened + 1 : closed].strip()
        upper = [w.upper() for w in words]
        for n in (3, 2, 1):
            method: Callable | None = VERBS.get(" ".join(upper[:n]))
            if len(upper) >= n and method:
                return method(self, inner, words[n:])
        raise InvalidArgument(f"unknown command {' '.join(upper)!r}")

    def _need(self, inner: str | None) -> str:
        if not inner:
            raise InvalidArgument("arguments are missing")
        return inner

    def where(self, inner, rest):
        conditions, table = parse_conditions(self._need(inner)), self.table()
        if self.governor.mode != "off":
            self.governor.admit(conditions, table.schema, table.df.count(), self._stats())
        hit = table.where(conditions)
        return Result(hit.orderBy("id"), f"matched {hit.count()}")

    def count(self, inner, rest):
        row = self.table().count(parse_conditions(inner) if inner else None).first()
        return Result(text=f"{row['matched']} / {row['total']}" if inner else str(row["total"]))

    def _aggregate(self, inner, what: str) -> Result:
        attribute, conditions = aggregate_arguments(self._need(inner))
        df = getattr(self.table(), what)(attribute, conditions)
        value = df.first()["value"]
        empty = "no numeric rows" if what == "avg" else "no rows"
        return Result(df, empty if value is None else f"{value:.6f}" if isinstance(value, float) else str(value))

    def sum(self, inner, rest):
        return self._aggregate(inner, "sum")

    def avg(self, inner, rest):
        return self._aggregate(inner, "avg")

    def min(self, inner, rest):
        return self._aggregate(inner, "min")

    def max(self, inner, rest):
        return self._aggregate(inner, "max")

    def wherep(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        if len(tokens) != 5 or tokens[1].upper() != "WHERE" or tokens[3] not in ("=", "=="):
            raise InvalidArgument("expected proj, WHERE, key, =, value")
        return Result(self.table().project(tokens[0], tokens[2], tokens[4]))

    def find(self, inner, rest):
        hit = self.table().find(self._id(self._need(inner)))
        if hit.isEmpty():
            raise NotFound("no such id")
        return Result(hit)

    def findpk(self, inner, rest):
        hit = self.table().find_pk(split_arguments(self._need(inner))[0])
        if hit.isEmpty():
            raise NotFound("no such key")
        return Result(hit)

    def page(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        if len(tokens) < 2:
            raise InvalidArgument("expected page, size")
        number, size = parse(tokens[0], "int"), parse(tokens[1], "int")
        order, descending, after = None, False, None
        for token in tokens[2:]:
            if token.lower() in ("asc", "desc"):
                descending = token.lower() == "desc"
            elif token.lower().startswith("after="):
                after = parse(token[6:], "int")
            else:
                order = token
        table = self.table()
        if after is not None:
            if order not in (None, "id"):
                raise InvalidArgument("after= needs the order of ids")
            return Result(table.page_after(after, size, descending))
        found = table.page(number, size, order, descending)
        if number > 1 and found.isEmpty():
            raise InvalidArgument("beyond the last page")
        return Result(found)

    def page_json(self, number: int, size: int, order: str = "id", descending: bool = False) -> str:
        table = self.table()
        rows = table.page(number, size, order, descending).toJSON().collect()
        types = {"id": "int"} | dict(table.schema.attributes)
        return json.dumps({"page": number, "size": size, "headers": ["id", *table.schema.names], "types": types, "rows": [json.loads(r) for r in rows]}, sort_keys=True)

    def qbal(self, inner, rest):
        table, least = self.table(), float(parse(self._need(inner), "double"))
        row = table.balance_summary(least).first()
        return Result(table.balance_hits(least), f"matched {row['matched']} total {row['total']}")

    def scan(self, inner, rest):
        return Result(self.log().history(staged=self.txn.staged if self.txn else ()).orderBy("_seq", "id"))

    def explain_where(self, inner, rest):
        conditions, table = parse_conditions(self._need(inner)), self.table()
        hit = table.where(conditions)
        text = f"plan {explain.label(conditions, table.schema)} matched {hit.count()}\n{explain.physical(hit)}"
        return Result(hit, text)

    def show_plan(self, inner, rest):
        return Result(text=self.where_plan_json(self._need(inner)))

    def insert(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        table, key = self.table(), self._id(tokens[0])
        values = self._values(table.schema, tokens[1:], fill=True)
        if not table.find(key).isEmpty():
            raise Conflict(f"id {key} exists")
        pk = table.schema.primary_key
        if pk != "id":
            self._check_unique(table, pk, values[table.schema.names.index(pk)])
        self._write(self._row(table.schema, key, values))
        return Result(text="inserted 1")

    def bulk_rows(self, start: int, n: int, dept: str | None = None) -> DataFrame:
        """The deterministic generator: values by attribute name and type from the id."""
        rows, schema = self.spark.range(start, start + n).select(F.col("id").cast("int").alias("id")), self.log().schema()
        return generated(rows, schema, dept)

    def bulk_insert(self, inner, rest, fast: bool = False):
        tokens = split_arguments(self._need(inner))
        if len(tokens) not in (2, 3):
            raise InvalidArgument("expected start, count")
        start, n = self._id(tokens[0]), parse(tokens[1], "int")
        if n < 1:
            raise InvalidArgument("count is at least 1")
        table, rows = self.table(), self.bulk_rows(start, n, tokens[2] if len(tokens) == 3 else None)
        fresh = fast and table.schema.primary_key == "id" and table.df.where(F.col("id").between(start, start + n - 1)).isEmpty()
        return Result(text=f"inserted {self._write(rows) if fresh else self.insert_new(rows)}")

    def insert_new(self, rows: DataFrame) -> int:
        """Insert the rows (id and attributes) whose id and key value the table doesn't have. Gives their number."""
        table = self.table()
        for key in dict.fromkeys(("id", table.schema.primary_key)):
            rows = rows.join(table.df.select(key), key, "left_anti")
        return self._write(rows)

    def bulk_insert_fast(self, inner, rest):
        return self.bulk_insert(inner, rest, fast=True)

    def update(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        table, key = self.table(), self._id(tokens[0])
        values = self._values(table.schema, tokens[1:], fill=False)
        if table.find(key).isEmpty():
            raise NotFound(f"no id {key}")
        if (pk := table.schema.primary_key) != "id":
            self._check_unique(table, pk, values[table.schema.names.index(pk)], but=key)
        self._write(self._row(table.schema, key, values))
        return Result(text="updated 1")

    def _set(self, table: Table, hit: DataFrame, name: str, text: str) -> int:
        if name == "id" or name not in table.schema.names:
            raise InvalidArgument(f"{name} can't be set")
        value = parse(text, table.schema.kind(name), dt.datetime.now(dt.UTC).replace(tzinfo=None))
        if name == table.schema.primary_key:
            if hit.limit(2).count() > 1:
                raise Conflict("the key would repeat")
            first = hit.first()
            self._check_unique(table, name, value, but=first["id"] if first else None)
        return self._write(hit.withColumn(name, literal(value, table.schema.kind(name))))

    def update_where(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        if len(tokens) < 6 or tokens[2].upper() != "WHERE":
            raise InvalidArgument("expected k, v, WHERE, condition")
        table = self.table()
        return Result(text=f"updated {self._set(table, table.where(tokens[3:]), tokens[0], tokens[1])}")

    def set_attribute(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        if len(tokens) != 3:
            raise InvalidArgument("expected id, k, v")
        table = self.table()
        hit = table.find(self._id(tokens[0]))
        if hit.isEmpty():
            raise NotFound(f"no id {tokens[0]}")
        return Result(text=f"updated {self._set(table, hit, tokens[1], tokens[2])}")

    def set_attribute_multi(self, inner, rest):
        tokens = split_arguments(self._need(inner))
        if len(tokens) < 3:
            raise InvalidArgument("expected k, v, id...")
        table, ids = self.table(), sorted({self._id(t) for t in tokens[2:]})
        hit = table.df.where(F.col("id").isin(ids))
        if hit.count() != len(ids):
            raise NotFound("an id is missing; nothing is set")
        return Result(text=f"updated {self._set(table, hit, tokens[0], tokens[1])}")

    def delete(self, inner, rest):
        hit = self.table().find(self._id(self._need(inner)))
        if hit.isEmpty():
            raise NotFound("no such id")
        return Result(text=f"deleted {self._write(hit, deleted=True)}")

    def delete_pk(self, inner, rest):
        hit = self.table().find_pk(split_arguments(self._need(inner))[0])
        if hit.isEmpty():
            raise NotFound("no such key")
        return Result(text=f"deleted {self._write(hit, deleted=True)}")

    def delete_where(self, inner, rest):
        return Result(text=f"deleted {self._write(self.table().where(self._need(inner)), deleted=True)}")

    # definition

    def _no_transaction(self) -> None:
        if self.txn:
            raise TransactionError("not inside a transaction")

    def rename_attribute(self, inner, rest):
        self._no_transaction()
        tokens, log = split_arguments(self._need(inner)), self.log()
        schema = log.schema()
        if len(tokens) != 2 or tokens[0] not in schema.names or tokens[1] in ["id", *schema.names]:
            raise InvalidArgument("expected old, new")
        old, new = tokens
        renamed = TableSchema([(new if n == old else n, k) for n, k in schema.attributes], new if schema.primary_key == old else schema.primary_key, schema.label)
        log.replace(log.current().withColumnRenamed(old, new), renamed)
        return Result(text=f"renamed {old} to {new}")

    def delete_attribute(self, inner, rest):
        self._no_transaction()
        log, name = self.log(), self._need(inner)
        schema = log.schema()
        if name not in schema.names or name == schema.primary_key:
            raise InvalidArgument(f"{name} can't be dropped")
        reduced = TableSchema([(n, k) for n, k in schema.attributes if n != name], schema.primary_key, schema.label)
        log.replace(log.current().drop(name), reduced)
        return Result(text=f"dropped {name}")

    def create_table(self, inner, rest):
        self.workspace.create(self._need(inner), TableSchema(list(self._schema.attributes), self._schema.primary_key))
        self.name = inner
        return Result(text=f"created {inner}")

    def use(self, inner, rest):
        if not self.workspace.has(self._need(inner)):
            raise NotFound(f"no table {inner}")
        self.set_table(inner)
        return Result(text=f"using {inner}")

    def drop_table(self, inner, rest):
        self._no_transaction()
        self.workspace.drop(self._need(inner))
        self.name = None if self.name == inner else self.name
        return Result(text=f"dropped {inner}")

    def rename_table(self, inner, rest):
        self._no_transaction()
        self.log()
        self.workspace.rename(self.name, self._need(inner))
        self.name = inner
        return Result(text=f"renamed to {inner}")

    def define(self, inner, rest):
        self._no_transaction()
        schema = TableSchema.parse(split_arguments(self._need(inner)))
        if self.name:
            log = self.log()
            old, rows = log.schema(), log.current()
            schema.label = old.label
            if old.primary_key in schema.names:
                schema.primary_key = old.primary_key
            if log.versions():
                held = [c for c in schema.names if c in rows.columns]
                log.replace(rows.select("id", *(F.col(c).try_cast(dict((f.name, f.dataType) for f in schema.struct().fields)[c]).alias(c) for c in held)), schema)
            else:
                log.set_schema(schema)
        self._schema = schema
        return Result(text=f"{len(schema.attributes)} attributes")

    def set_primary_key(self, inner, rest):
        self._no_transaction()
        log, name = self.log(), self._need(inner)
        schema = log.schema()
        if name != "id" and name not in schema.names:
            raise InvalidArgument(f"unknown attribute {name}")
        text = F.col(f"`{name}`").cast("string")
        row = log.current().agg(F.count(F.lit(1)).alias("n"), F.count(text).alias("held"), F.countDistinct(text).alias("distinct")).first()
        if not row["n"] == row["held"] == row["distinct"]:
            raise Conflict(f"{name} is missing or repeats")
        schema.primary_key = name
        log.set_schema(schema)
        return Result(text=f"key {name}")

    def show_attributes(self, inner, rest):
        schema = self.log().schema()
        return Result(text="\n".join(f"{n}:{k}" + (" (key)" if n == schema.primary_key else "") for n, k in [("id", "int"), *schema.attributes]))

    def show_key(self, inner, rest):
        return Result(text=self.log().schema().primary_key)

    def create_schema(self, inner, rest):
        self.workspace.create_namespace(self._need(inner))
        return Result(text=f"created {inner}")

    def drop_schema(self, inner, rest):
        self.workspace.drop_namespace(self._need(inner))
        return Result(text=f"dropped {inner}")

    def list_schemas(self, inner, rest):
        return Result(text="\n".join(f"{n} {k}" for n, k in self.workspace.namespaces().items()))

    def alter_table(self, inner, rest):
        words = [w.upper() for w in rest]
        if len(rest) == 3 and words[1:] == ["SET", "SCHEMA"] and inner:
            self.workspace.label(rest[0], inner)
        elif len(rest) == 3 and words[1:] == ["REMOVE", "SCHEMA"]:
            self.workspace.label(rest[0], "")
        else:
            raise InvalidArgument("expected ALTER TABLE t SET SCHEMA(s) or REMOVE SCHEMA")
        return Result(text=f"altered {rest[0]}")

    def list_tables(self, inner, rest):
        return Result(text="\n".join(("* " if t == self.name else "  ") + t + (" (schema)" if self.workspace.log(t).schema().attributes else "") for t in self.workspace.tables()))

    # maintenance

    def reset(self, inner, rest):
        self._no_transaction()
        log = self.log()
        log.replace(self.spark.createDataFrame([], log.schema().struct()))
        return Result(text="emptied")

    def vacuum(self, inner, rest):
        self._no_transaction()
        if (inner or "".join(rest)).upper() == "QUEUE":
            done = self.workspace.run_vacuum()
            self.counters["compactions"] += len(done)
            return Result(text="\n".join(f"compacted {n}" for n in done))
        self.log().compact()
        self.log().sweep()
        self.counters["compactions"] += 1
        return Result(text="compacted")

    def reorder(self, inner, rest):
        self._no_transaction()
        log = self.log()
        if log.schema().primary_key != "id":
            raise InvalidArgument("the key must be id")
        table = self.table()
        mapping = table.dense_ids()
        rows = table.df.join(mapping, table.df["id"] == mapping["old_id"]).drop("id", "old_id").withColumnRenamed("new_id", "id")
        log.replace(rows)
        return Result(mapping, "renumbered")

    def show_storage(self, inner, rest):
        return Result(stats.with_bytes(stats.storage_health(self.log().history()), self.log().size()))

    def show_status(self, inner, rest):
        if [r.upper() for r in rest] == ["JSON"]:
            return Result(text=json.dumps(self.settings | {"isolation": self.isolation, "write_conflict": self.on_conflict[0]} | self.counters, sort_keys=True))
        return Result(text="\n".join(f"{k} {v}" for k, v in self.settings.items()))

    def setting(self, name: str, inner, rest):
        value = inner or " ".join(rest)
        if value:
            self.settings[name] = value
        return Result(text=f"{name} {self.settings[name]}")

    def scan_policy(self, inner, rest):
        """``SCANPOLICY(mode [, name=value]...)`` with least_rows, per_second, cap and budget; without arguments it tells."""
        tokens = split_arguments(inner) if inner else rest
        guard, kinds = self.governor, {"least_rows": int, "per_second": float, "cap": float, "budget": int}
        if tokens:
            mode = tokens[0].lower()
            given = [t.partition("=") for t in tokens[1:]]
            if mode not in guard.MODES or any(k.strip() not in kinds for k, _, _ in given):
                raise InvalidArgument(f"expected one of {', '.join(guard.MODES)} and least_rows=, per_second=, cap= or budget=")
            values = {k.strip(): kinds[k.strip()](parse(v.strip(), "int" if kinds[k.strip()] is int else "double")) for k, _, v in given}
            if min(values.values(), default=0) < 0 or values.get("cap", 0) > 1:
                raise InvalidArgument("values are at least 0, and cap is at most 1")
            guard.mode = mode
            for k, v in values.items():
                setattr(guard, k, v)
        return Result(text=json.dumps({k: getattr(guard, k) for k in ("mode", *kinds, "checks", "warned", "rejected", "budget_bound")}))

    def analyze_table(self, inner, rest):
        return Result(text=stats.to_text(self.analyze()))

    def show_log(self, inner, rest):
        return Result(text="\n".join(self.log_lines))

    def help(self, inner, rest):
        return Result(text="\n".join(sorted(VERBS)))

    # transactions

    def begin(self, inner, rest):
        if self.txn:
            raise TransactionError("a transaction is open")
        if rest:
            self.use(rest[0], [])
        self.txn = Transaction(self.name or "", self.log().manifest())
        return Result(text="begun")

    def _open(self) -> Transaction:
        if not self.txn:
            raise TransactionError("no transaction is open")
        return self.txn

    def commit(self, inner, rest):
        """Publish all staged statements at once. Another session's commit to the same ids or key values is a Conflict."""
        txn, log = self._open(), self.workspace.log(self._open().table)
        if txn.staged:
            now = log.manifest()
            if now["version"] != txn.manifest["version"]:
                self._rebase(log, txn, now)
            else:
                log.publish(txn.manifest, txn.staged)
        self.txn = None
        self.counters["commits"] += 1
        return Result(text="committed")

    def _rebase(self, log: Log, txn: Transaction, now: dict) -> None:
        schema = log.schema()
        own = log._read([f for f, _ in txn.staged], schema)
        held = {f for f, _ in txn.manifest["deltas"]}
        others = [f for f, _ in now["deltas"] if f not in held]
        if now["base"] != txn.manifest["base"]:
            others.append(now["base"])
        theirs = log._read(others, schema)
        keys = ["id"] if schema.primary_key == "id" else ["id", schema.primary_key]
        if any(not own.select(k).join(theirs.select(k), k, "left_semi").isEmpty() for k in keys):
            self.counters["conflicts"] += 1
            raise Conflict("another session wrote the same rows")
        shift = now["seq"] - txn.manifest["seq"]
        folders = []
        for folder, seq in txn.staged:
            rows = log._read([folder], schema)
            gone = rows.where("_deleted").limit(1).count() > 0
            folders.append((log.stage(rows, schema, seq + shift, gone), seq + shift))
        log.publish(now, folders)

    def rollback(self, inner, rest):
        if len(rest) == 2 and rest[0].upper() == "TO":
            return self._rollback_to(rest[1])
        txn = self._open()
        for folder, _ in txn.staged:
            self.workspace.log(txn.table).store.delete(f"data/{folder}")
        self.txn = None
        self.counters["rollbacks"] += 1
        return Result(text="rolled back")

    def _place(self, name: str) -> int:
        names = [n for n, _ in self._open().savepoints]
        if name not in names:
            raise NotFound(f"no savepoint {name}")
        return len(names) - 1 - names[::-1].index(name)

    def savepoint(self, inner, rest):
        if len(rest) != 1:
            raise InvalidArgument("expected a name")
        self._open().savepoints.append((rest[0], len(self.txn.staged)))
        return Result(text=f"savepoint {rest[0]}")

    def _rollback_to(self, name: str) -> Result:
        at = self._place(name)
        keep = self.txn.savepoints[at][1]
        for folder, _ in self.txn.staged[keep:]:
            self.workspace.log(self.txn.table).store.delete(f"data/{folder}")
        del self.txn.staged[keep:], self.txn.savepoints[at + 1 :]
        return Result(text=f"rolled back to {name}")

    def release(self, inner, rest):
        if len(rest) != 1:
            raise InvalidArgument("expected a name")
        del self.txn.savepoints[self._place(rest[0]) :]
        return Result(text=f"released {rest[0]}")

    def set_isolation(self, inner, rest):
        value = (inner or "".join(rest)).lower()
        if value:
            held = {"snapshot": "snapshot", "si": "snapshot", "read_committed": "read_committed", "rc": "read_committed"}
            if value not in held:
                raise InvalidArgument("snapshot or read_committed")
            self.isolation = held[value]
        return Result(text=self.isolation)

    def write_conflict(self, inner, rest):
        words = [w.lower() for w in ((inner or "").replace(",", " ").split() or rest)]
        if words:
            if words[0] not in ("reject", "wait"):
                raise InvalidArgument("reject or wait")
            self.on_conflict = (words[0], int(parse(words[1], "int")) if len(words) > 1 else 1000)
        return Result(text=" ".join(map(str, self.on_conflict)))

    def recover_lsn(self, inner, rest):
        self._no_transaction()
        self.log().recover(parse(" ".join(rest), "int"))
        return Result(text="recovered")

    def recover_time(self, inner, rest):
        self._no_transaction()
        log = self.log()
        log.recover(log.seq_at(parse(" ".join(rest), "int")))
        return Result(text="recovered")

    # files

    def export(self, inner, rest):
        form = rest[0] if rest else ""
        if form not in ("CSV", "JSON"):
            raise InvalidArgument("EXPORT CSV or EXPORT JSON")
        path = rest[1] if len(rest) > 1 else f"{self.workspace.root}/{self.name}.{form.lower()}"
        files.export(self.frame(), ["id", *self.log().schema().names], path, form)
        return Result(text=f"exported to {path}")

    def import_dir(self, inner, rest):
        return Result(text="\n".join(f"{n} {s}" for n, s in self.workspace.import_folder(self._need(inner)).items()))


def generated(rows: DataFrame, schema: TableSchema, dept: str | None = None) -> DataFrame:
    """Rows (id) with the bulk generator's values.

    A key attribute gets the id, or its name and the id; name is u<id>, dept goes by id mod 4, age and salary by the id;
    others go by type.
    """
    key, today = F.col("id"), dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
    named = {"name": F.concat(F.lit("u"), key.cast("string")), "dept": F.lit(dept) if dept else F.element_at(F.array(*map(F.lit, DEPARTMENTS)), (key % 4 + 1).cast("int")), "age": 20 + key % 40, "salary": 8000 + key % 50000}
    tenth = (key % 10000) / 10

    def value(name: str, kind: str):
        plain = {"int": key % 1_000_000, "float": tenth, "double": tenth, "bool": key % 2 == 0, "char": F.lit("A"), "date": F.lit(str(today.date())), "datetime": F.lit(str(today)), "timestamp": F.lit(str(today))}
        if name == schema.primary_key:
            return key if kind == "int" else F.concat(F.lit(f"{name}_"), key.cast("string"))
        if name in named and (kind in NUMERIC) == (name in ("age", "salary")):
            return named[name]
        return plain.get(kind, F.concat(F.lit(f"{name}_"), key.cast("string")))

    return rows.select("id", *(value(n, k).cast(SPARK[k]).alias(n) for n, k in schema.attributes))


def inverse(command: str, before: dict | None = None) -> str | None:
    """The command that undoes another, given the row before it as a dict (with ``id``), or None if there is none."""
    m = re.match(r"\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*\((.*)\)\s*$", command)
    if not m:
        return None
    verb, args = " ".join(m[1].upper().split()), split_arguments(m[2])
    row = ", ".join(f'"{v}"' if "," in str(v) else str(v) for v in (before or {}).values())
    if verb == "INSERT":
        return f"DELETE({args[0]})"
    if verb == "DELETE" and before:
        return f"INSERT({row})"
    if verb == "UPDATE" and before:
        return f"UPDATE({row})"
    if verb == "SETATTR" and before:
        return f"SETATTR({args[0]}, {args[1]}, {before.get(args[1], '')})"
    if verb == "RENATTR":
        return f"RENATTR({args[1]}, {args[0]})"
    if verb == "CREATE TABLE":
        return f"DROP TABLE({args[0]})"
    if verb == "USE" and before:
        return f"USE({before['table']})"
    if verb == "RENAME TABLE" and before:
        return f"RENAME TABLE({before['table']})"
    if verb == "CREATE SCHEMA":
        return f"DROP SCHEMA({args[0]})"
    if verb == "DEFATTR" and before:
        return f"DEFATTR({', '.join(f'{n}:{type_name(k)}' for n, k in before.items() if n != 'id')})"
    if verb == "SET PRIMARY KEY" and before:
        return f"SET PRIMARY KEY({before['primary_key']})"
    return None


S = Session
VERBS: dict[str, Callable] = {
    "WHERE": S.where, "COUNT": S.count, "SUM": S.sum, "AVG": S.avg, "MIN": S.min, "MAX": S.max, "WHEREP": S.wherep, "FIND": S.find, "FINDPK": S.findpk, "PAGE": S.page, "QBAL": S.qbal, "SCAN": S.scan,
    "EXPLAIN WHERE": S.explain_where, "SHOW PLAN": S.show_plan, "INSERT": S.insert, "BULKINSERT": S.bulk_insert, "BULKINSERTFAST": S.bulk_insert_fast, "UPDATE": S.update, "UPDATEWHERE": S.update_where,
    "SETATTR": S.set_attribute, "SETATTRMULTI": S.set_attribute_multi, "DELETE": S.delete, "DELETEPK": S.delete_pk, "DELETEWHERE": S.delete_where, "RENATTR": S.rename_attribute, "DELATTR": S.delete_attribute,
    "CREATE TABLE": S.create_table, "USE": S.use, "DROP TABLE": S.drop_table, "RENAME TABLE": S.rename_table, "DEFATTR": S.define, "SET PRIMARY KEY": S.set_primary_key, "SHOW ATTR": S.show_attributes, "DESCRIBE": S.show_attributes,
    "SHOW KEY": S.show_key, "SHOW PRIMARY KEY": S.show_key, "CREATE SCHEMA": S.create_schema, "DROP SCHEMA": S.drop_schema, "LIST SCHEMAS": S.list_schemas, "SHOW SCHEMAS": S.list_schemas, "ALTER TABLE": S.alter_table,
    "LIST TABLES": S.list_tables, "SHOW TABLES": S.list_tables, "RESET": S.reset, "VACUUM": S.vacuum, "CONFIRM_REORDER": S.reorder, "SHOW STORAGE": S.show_storage, "SHOW TUNING": S.show_status, "SHOW STATUS": S.show_status,
    "ANALYZE": S.analyze_table, "SCANPOLICY": S.scan_policy, "SHOWLOG": S.show_log, "HELP": S.help, "EXIT": lambda self, inner, rest: Result(text="bye"), "BEGIN": S.begin, "COMMIT": S.commit, "ROLLBACK": S.rollback, "SAVEPOINT": S.savepoint,
    "RELEASE SAVEPOINT": S.release, "TXNISOLATION": S.set_isolation, "WRITECONFLICT": S.write_conflict, "RECOVER TO LSN": S.recover_lsn, "RECOVER TO TIME": S.recover_time, "EXPORT": S.export, "IMPORTDIR": S.import_dir,
    **{name: (lambda self, inner, rest, name=name: self.setting(name, inner, rest)) for name in SETTINGS},
}
