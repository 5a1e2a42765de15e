"""Conditions: parsing, compilation to a Column, and what can be told of them without running."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.types import as_type, literal, parse
from ..sources.schema import TableSchema

OPERATORS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", ">": ">", "<": "<", ">=": ">=", "<=": "<=", "contains": "contains"}


@dataclass(frozen=True)
class Condition:
    attribute: str
    operator: str
    value: str
    link: str = ""  # AND or OR with all that stands before


def split_arguments(text: str) -> list[str]:
    """Cut at commas outside of double quotes; outer quotes and white space are taken off."""
    out, held, quoted = [], "", False
    for c in text:
        if c == '"':
            quoted = not quoted
        if c == "," and not quoted:
            out.append(held)
            held = ""
        else:
            held += c
    out.append(held)
    out = [x.strip() for x in out]
    return [x[1:-1] if len(x) >= 2 and x[0] == x[-1] == '"' else x for x in out] if text.strip() else []


def parse_conditions(tokens: list[str] | str) -> list[Condition]:
    """``attr, op, value [, AND|OR, attr, op, value]...``; raises InvalidArgument. No token gives no condition."""
    tokens = split_arguments(tokens) if isinstance(tokens, str) else list(tokens)
    if not tokens:
        return []
    if len(tokens) % 4 != 3:
        raise InvalidArgument("a condition is attr, op, value, joined by AND or OR")
    out = []
    for at in range(0, len(tokens), 4):
        attribute, operator, value = tokens[at : at + 3]
        link = tokens[at - 1].upper() if at else ""
        if at and link not in ("AND", "OR"):
            raise InvalidArgument(f"{tokens[at - 1]!r} is neither AND nor OR")
        if operator.lower() not in OPERATORS or not attribute:
            raise InvalidArgument(f"unknown operator {operator!r}")
        out.append(Condition(attribute, OPERATORS[operator.lower()], value, link))
    return out


def compile_one(condition: Condition, schema: TableSchema, stored: T.StructType, missing_as_empty: bool = False) -> Column:
    """One condition as a typed Column. Null never matches, unless missing text is to read as empty."""
    kinds = {f.name: f.dataType for f in stored.fields}
    name, operator, value = condition.attribute, condition.operator, condition.value
    if name not in kinds:
        raise InvalidArgument(f"unknown attribute {name!r}")
    kind, column = schema.kind(name), F.col(f"`{name}`")
    if operator == "contains":
        text = column if isinstance(kinds[name], T.StringType) else column.cast("string")
        return (F.coalesce(text, F.lit("")) if missing_as_empty else text).contains(value)
    typed, right = as_type(column, kind, kinds[name]), literal(parse(value, kind), kind)
    if missing_as_empty and kind in ("string", "char"):
        typed = F.coalesce(typed, F.lit(""))
    return {"=": typed == right, "!=": typed != right, ">": typed > right, "<": typed < right, ">=": typed >= right, "<=": typed <= right}[operator]


def compile_conditions(conditions: list[Condition], schema: TableSchema, stored: T.StructType, missing_as_empty: bool = False) -> Column:
    """All conditions, folded from left to right: ``a OR b AND c`` is ``(a OR b) AND c``. None is always true."""
    columns = [(c.link, compile_one(c, schema, stored, missing_as_empty)) for c in conditions]
    if not columns:
        return F.lit(True)
    return reduce(lambda left, item: left & item[1] if item[0] == "AND" else left | item[1], columns[1:], columns[0][1])


def fingerprint(conditions: list[Condition]) -> str:
    """A canonical text of a condition list, the same for equal lists."""
    return "p1" + "".join(f"\x1e{c.link}\x1f{c.attribute}\x1f{c.operator}\x1f{c.value}" for c in conditions)


def closed_range(conditions: list[Condition], schema: TableSchema) -> tuple[str, int, int] | None:
    """(attribute, low, high) of an AND chain of ``>=`` and ``<=`` on one int attribute with both ends, else None."""
    if not conditions or any(c.link == "OR" or c.operator not in (">=", "<=") for c in conditions):
        return None
    names = {c.attribute for c in conditions}
    if len(names) != 1 or schema.kind(name := names.pop()) != "int":
        return None
    lows = [parse(c.value, "int") for c in conditions if c.operator == ">="]
    highs = [parse(c.value, "int") for c in conditions if c.operator == "<="]
    return (name, max(lows), min(highs)) if lows and highs else None


def aggregate_arguments(text: str) -> tuple[str, list[Condition]]:
    """``attr`` or ``attr, WHERE, condition``."""
    tokens = split_arguments(text)
    if not tokens:
        raise InvalidArgument("an attribute is missing")
    if len(tokens) == 1:
        return tokens[0], []
    if tokens[1].upper() != "WHERE" or len(tokens) == 2:
        raise InvalidArgument("expected attr, WHERE, condition")
    return tokens[0], parse_conditions(tokens[2:])
