"""What a condition list would do: access-path label, candidates with costs, and an optional guard against scans."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame

from ..errors import Blocked
from ..operators.predicate import Condition, fingerprint
from ..operators.stats import BLIND, blind_estimate, selectivity
from ..sources.schema import TableSchema


def scan_cost(rows: int) -> float:
    return float(rows)


def point_cost() -> float:
    return 1.0


def equal_cost(rows: int, share: float) -> float:
    return max(4.0, rows * share)


def label(conditions: list[Condition], schema: TableSchema) -> str:
    """The access path that a keyed store would take; on Spark it names what pushdown and statistics can prune by."""
    if not conditions:
        return "full_scan_all"
    equal = [c for c in conditions if c.operator == "="]
    if len(conditions) == 1:
        c = conditions[0]
        if c.operator == "=":
            return "id_lookup" if c.attribute == "id" else "pk_lookup" if c.attribute == schema.primary_key else "eq_sidecar"
        return "fallback_scan"
    links = {c.link for c in conditions[1:]}
    if links == {"AND"}:
        if len(equal) == len(conditions) == 2:
            return "and_intersect_2"
        return "and_seed_filter" if equal else "and_ordered_scan"
    if links == {"OR"} and len(equal) == len(conditions):
        return "or_union_verify"
    return "fallback_scan"


def candidates(conditions: list[Condition], schema: TableSchema, rows: int, stats: dict | None = None) -> list[dict]:
    """Access paths with cost and reason, cheapest first."""
    out = [{"path": "scan", "cost": scan_cost(rows), "reason": "reads all rows"}]
    for c in conditions:
        if c.operator != "=" or (len(conditions) > 1 and any(x.link == "OR" for x in conditions)):
            continue
        if c.attribute in ("id", schema.primary_key):
            out.append({"path": f"point({c.attribute})", "cost": point_cost(), "reason": "unique key"})
        else:
            held = (stats or {}).get("columns", {}).get(c.attribute)
            share = selectivity("=", held["distinct"]) if held else 0.08
            out.append({"path": f"equal({c.attribute})", "cost": equal_cost(rows, share), "reason": "from statistics" if held else "fixed factor"})
    return sorted(out, key=lambda x: (x["cost"], x["path"]))


def estimate(conditions: list[Condition], schema: TableSchema, rows: int, stats: dict | None = None) -> float:
    """Rows that a condition list keeps: a unique key one, other conditions by the statistics of their attribute, or by
    the fixed factors where there are none. AND multiplies shares, OR adds them; from one row to all."""
    held = (stats or {}).get("columns", {})

    def share(c: Condition) -> float:
        if c.operator == "=" and c.attribute in ("id", schema.primary_key):
            return 1.0 / max(1, rows)
        if c.attribute in held:
            return selectivity(c.operator, held[c.attribute]["distinct"])
        return BLIND.get(c.operator, BLIND["range"])

    if not held:
        return blind_estimate(rows, conditions)
    kept = 1.0
    for i, c in enumerate(conditions):
        kept = share(c) if i == 0 else kept * share(c) if c.link == "AND" else min(1.0, kept + share(c))
    return min(float(rows), max(1.0, rows * kept))


def show_plan(conditions: list[Condition], schema: TableSchema, rows: int, matched: int | None = None, stats: dict | None = None, seq: int | None = None) -> str:
    """The plan as JSON."""
    return json.dumps({"plan_id": label(conditions, schema), "candidates": candidates(conditions, schema, rows, stats), "estimated_rows": estimate(conditions, schema, rows, stats), "matched_rows": matched, "fingerprint": fingerprint(conditions), "snapshot_seq": seq}, sort_keys=True)


def physical(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


#: From so many rows on, the largest share of a table that a condition may be estimated to read, without
#: and with an OR; four conditions or more lower it by a tenth.
SCAN_CAPS = ((1_000_000, 0.60, 0.45), (300_000, 0.70, 0.55), (100_000, 0.78, 0.65), (0, 0.85, 0.85))


class Governor:
    """Guards against scans by conditions without an equality; off unless asked for.

    Modes: off; warn (lets all through, counts them); ratelimit (at most ``per_second``, and none that is estimated to
    read more than the share ``cap`` of the table or ``budget`` rows); reject. Without ``per_second`` it is 2, and 1 for
    tables of a million rows or conditions of four parts; without ``cap`` it is that of ``SCAN_CAPS``.
    """

    MODES = ("off", "warn", "ratelimit", "reject")

    def __init__(self, mode: str = "off", least_rows: int = 5000, per_second: float | None = None, cap: float | None = None, budget: int = 0):
        self.mode, self.least_rows, self.per_second, self.cap, self.budget = mode, least_rows, per_second, cap, budget
        self.checks = self.warned = self.rejected = self.budget_bound = 0
        self._times: list[float] = []

    def most_rows(self, conditions: list[Condition], rows: int) -> int:
        """The most rows that a condition may be estimated to read."""
        plain, either = next((p, e) for least, p, e in SCAN_CAPS if rows >= least)
        ratio = (either if any(c.link == "OR" for c in conditions) else plain) * (0.9 if len(conditions) >= 4 else 1.0)
        return max(1, int(rows * (self.cap or ratio)))

    def admit(self, conditions: list[Condition], schema: TableSchema, rows: int, stats: dict | None = None) -> None:
        self.checks += 1
        if self.mode == "off" or rows < self.least_rows or label(conditions, schema) not in ("fallback_scan", "and_ordered_scan"):
            return
        if self.mode == "warn":
            self.warned += 1
            return
        if self.mode == "reject":
            self._refuse("policy_reject")
        most = self.most_rows(conditions, rows)
        if self.budget and self.budget < most:
            self.budget_bound += 1
            most = self.budget
        if estimate(conditions, schema, rows, stats) >= most:
            self._refuse("policy_reject: the estimated scan is too wide")
        allowed = self.per_second if self.per_second is not None else 1 if rows >= 1_000_000 or len(conditions) >= 4 else 2
        now = time.monotonic()
        self._times = [t for t in self._times if now - t < 1.0]
        if allowed and len(self._times) >= allowed:
            self._refuse("policy_block")
        self._times.append(now)

    def _refuse(self, why: str) -> None:
        self.rejected += 1
        raise Blocked(why)
