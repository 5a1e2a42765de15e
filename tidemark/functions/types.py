"""Attribute types: names, Spark types, literals, validation and defaults."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument

#: Type names with their aliases and the Spark type of each, and the words for true and false.
ALIASES = {"integer": "int", "str": "string", "boolean": "bool"}
SPARK = {"int": T.LongType(), "char": T.StringType(), "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(), "datetime": T.TimestampType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType()}
NUMERIC = ("int", "float", "double")
TRUE, FALSE = ("1", "true", "y", "yes"), ("0", "false", "n", "no")


def type_name(name: str) -> str:
    """The canonical name of a type, case and aliases aside."""
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low not in SPARK:
        raise InvalidArgument(f"unknown type {name}")
    return low


def of_spark(kind: T.DataType) -> str:
    """The type name nearest to a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, T.FloatType):
        return "float"
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "string"


def parse(text: str, kind: str, now: dt.datetime | None = None):
    """The Python value of a literal; raises InvalidArgument. ``now`` stands for the word of that name."""
    text = text.strip()
    try:
        if kind == "int":
            if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(2**63) <= int(text) < 2**63:
                raise ValueError
            return int(text)
        if kind in ("float", "double"):
            return float(text)
        if kind == "bool":
            if text.lower() not in TRUE + FALSE:
                raise ValueError
            return text.lower() in TRUE
        if kind == "char":
            if len(text.encode()) != 1:
                raise ValueError
            return text
        if kind == "date":
            if text.lower() == "now" and now:
                return now.date()
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                raise ValueError
            return dt.date.fromisoformat(text)
        if kind in ("datetime", "timestamp"):
            if text.lower() == "now" and now:
                return now.replace(microsecond=0)
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                text += " 00:00:00"
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", text):
                raise ValueError
            return dt.datetime.fromisoformat(text)
    except ValueError:
        raise InvalidArgument(f"{text!r} is not a {kind}") from None
    return text


def default(kind: str, now: dt.datetime):
    """What a missing value of an INSERT becomes."""
    return {"int": 0, "float": 0.0, "double": 0.0, "bool": False, "date": now.date(), "datetime": now.replace(microsecond=0), "timestamp": now.replace(microsecond=0)}.get(kind, "0")


def literal(value, kind: str) -> Column:
    """A Spark literal of a parsed value in the type that comparisons use."""
    if kind in ("datetime", "timestamp"):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if kind == "date":
        return F.lit(value.isoformat()).cast("date")
    if kind == "int":
        return F.lit(value).cast("long")
    if kind in ("float", "double"):
        return F.lit(value).cast("double")
    return F.lit(value)


def as_type(column: Column, kind: str, stored: T.DataType) -> Column:
    """The column in its declared type; text that doesn't parse is null, columns of that type stay as they are."""
    if kind == of_spark(stored) or kind in ("string", "char") or (kind in ("datetime", "timestamp") and of_spark(stored) == "timestamp"):
        return column
    if kind == "int" and isinstance(stored, T.StringType):
        return F.when(column.rlike(r"^\s*[+-]?[0-9]+\s*$"), column.try_cast("long"))
    return column.try_cast(SPARK[kind])
