"""Export to CSV and JSON, import of table folders, and small files in any store that Hadoop knows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder that the context was given.

    Where neither is set a local master (tests, one machine) gets a temporary folder of its own; on a cluster that is an
    error, since a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Store:
    """Files of the file system of a path, through Hadoop, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.root, self._path, self._jvm, self._gateway = root.rstrip("/"), jvm.org.apache.hadoop.fs.Path, jvm, spark.sparkContext._gateway
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.fs.getContentSummary(self.path(name)).getLength()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "", folders: bool | None = None) -> list[str]:
        if not self.exists(name):
            return []
        found = self.fs.listStatus(self.path(name))
        return sorted(s.getPath().getName() for s in found if folders is None or s.isDirectory() == folders)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        """The whole file appears at once; without ``overwrite`` an existing one is a Conflict."""
        part = self.path(f"{name}.{self._jvm.java.util.UUID.randomUUID().toString()}.tmp")
        stream = self.fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename, options = self._jvm.org.apache.hadoop.fs.Options.Rename, None
        if overwrite:  # one step: readers see the old file or the new one
            options = self._gateway.new_array(rename, 1)
            options[0] = rename.OVERWRITE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(part, self.path(name), options)
        elif self.exists(name) or not self.fs.rename(part, self.path(name)):
            self.fs.delete(part, False)
            raise Conflict(f"{name} was written by another session")

    def modified(self, name: str) -> int:
        """Milliseconds of the last change."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise Conflict(f"{new} exists")

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def copy(self, source: str, name: str) -> None:
        path = self._path(source)
        fs = path.getFileSystem(self.fs.getConf())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, self.fs, self.path(name), False, self.fs.getConf())


def _text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return (F.when(column, "1").otherwise("0") if isinstance(field.dataType, T.BooleanType) else column.cast("string")).alias(field.name)


def _csv_line(df: DataFrame, columns: list[str]) -> Column:
    def cell(name: str) -> Column:
        text = F.coalesce(_text(df.schema[name]), F.lit(""))
        return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *(cell(c) for c in columns)).alias("line")


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column ``line``: RFC 4180 fields, quoted only if they hold a comma, a quote or a line break; null is empty."""
    return df.select(_csv_line(df, columns))


def json_values(df: DataFrame, columns: list[str], key: str) -> list[Column]:
    return [F.col(f"`{c}`") if c == key else F.coalesce(_text(df.schema[c]), F.lit("")).alias(c) for c in columns]


def json_rows(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """One column ``line``: an object whose ``key`` is a number and whose other values are strings; null is empty."""
    return df.select(F.to_json(F.struct(*json_values(df, columns, key))).alias("line"))


def export(df: DataFrame, columns: list[str], path: str, form: str, key: str = "id") -> None:
    """Write one file of all rows in the order of the key. ``form`` is CSV (with a header) or JSON (one array).

    The lines are made by all tasks; a single task writes the file, which is what one file means.
    """
    session, place = df.sparkSession, F.col(f"`{key}`").cast("long").alias("place")

    def fixed(section: int, line: str) -> DataFrame:
        return session.createDataFrame([(section, 0, line)], "section int, place long, line string")

    if form == "CSV":
        head = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\r\n') else c for c in columns)
        lines = fixed(0, head).unionAll(df.select(F.lit(1), place, _csv_line(df, columns)))
    elif form == "JSON":
        first = df.agg(F.min(F.col(f"`{key}`"))).first()[0]
        text = F.concat(F.when(F.col(f"`{key}`") == first, "").otherwise(","), F.to_json(F.struct(*json_values(df, columns, key))))
        lines = fixed(0, "[").unionAll(df.select(F.lit(1), place, text)).unionAll(fixed(2, "]"))
    else:
        raise InvalidArgument("the format is CSV or JSON")
    lines.repartition(1).sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)
