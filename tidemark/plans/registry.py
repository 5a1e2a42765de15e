"""The registered queries and their DuckDB statements.

Each query goes through the engine's own API; names follow the operators they show. Results carry a unique order where
they are pages, and money is summed as decimal so that both engines agree to the last digit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra, report, stats
from ..operators.predicate import parse_conditions
from ..operators.query import Table
from ..session import Session, generated
from ..sources import files
from ..sources.log import latest
from ..sources.schema import TableSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey", "nation": "n_nationkey", "region": "r_regionkey"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table.from_dataframe(read(spark, sf_dir, name), KEYS[name])


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def add(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on(name: str, source: str, sql: str | None, query: Callable[[Table], DataFrame]) -> None:
    """A query on one table."""
    add(name, sql, lambda spark, sf_dir: query(table(spark, sf_dir, source)))


# Filters. Left-to-right folding is spelled out by brackets in the SQL.
ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice")
for _name, _cond, _sql in (
    ("where_eq", "o_orderstatus,=,F", "o_orderstatus = 'F'"),
    ("where_ne", "o_orderstatus,!=,F", "o_orderstatus <> 'F'"),
    ("where_gt", "o_totalprice,>,200000", "o_totalprice > 200000"),
    ("where_lt", "o_totalprice,<,20000", "o_totalprice < 20000"),
    ("where_ge", "o_orderkey,>=,500", "o_orderkey >= 500"),
    ("where_le", "o_orderkey,<=,500", "o_orderkey <= 500"),
    ("where_contains", "o_orderpriority,contains,HIGH", "contains(o_orderpriority, 'HIGH')"),
    ("where_contains_numeric", "o_orderkey,contains,99", "contains(CAST(o_orderkey AS VARCHAR), '99')"),
    ("where_or3", "o_orderstatus,=,P,OR,o_totalprice,>,250000,OR,o_orderpriority,=,5-LOW", "o_orderstatus = 'P' OR o_totalprice > 250000 OR o_orderpriority = '5-LOW'"),
    ("where_mixed_leftfold", "o_orderstatus,=,P,OR,o_orderstatus,=,F,AND,o_totalprice,>,100000", "(o_orderstatus = 'P' OR o_orderstatus = 'F') AND o_totalprice > 100000"),
    ("where_id_range", "o_orderkey,>=,100,AND,o_orderkey,<=,900", "o_orderkey BETWEEN 100 AND 900"),
    ("where_date_range", "o_orderdate,>=,1995-01-01,AND,o_orderdate,<,1996-01-01", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
):
    on(_name, "orders", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_sql}", lambda t, c=_cond: t.where(c).select(*ORDER_COLUMNS))
on("where_and2", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45", lambda t: t.where("l_returnflag,=,R,AND,l_quantity,>,45").select("l_orderkey", "l_linenumber", "l_quantity"))
on("where_and4", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity >= 10 AND l_discount < 0.05", lambda t: t.where("l_returnflag,=,A,AND,l_linestatus,=,F,AND,l_quantity,>=,10,AND,l_discount,<,0.05").select("l_orderkey", "l_linenumber", "l_quantity"))
on("wherep_projection", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50", lambda t: t.project("c_name", "c_mktsegment", "BUILDING"))
on("find_by_id", "customer", "SELECT * FROM customer WHERE c_custkey = 42", lambda t: t.find(42))
on("findpk_text", "supplier", "SELECT * FROM supplier WHERE s_name = (SELECT min(s_name) FROM supplier) ORDER BY s_suppkey LIMIT 1", lambda t: Table(t.df, TableSchema(t.schema.attributes, "s_name"), "s_suppkey").find_pk(t.df.agg(F.min("s_name")).first()[0]))

# Aggregates.
on("count_all", "lineitem", "SELECT count(*) AS total FROM lineitem", lambda t: t.count())
on("count_where", "lineitem", "SELECT count(*) FILTER (l_quantity > 25) AS matched, count(*) AS total FROM lineitem", lambda t: t.count("l_quantity,>,25"))
on("count_eq_covering", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_returnflag", lambda t: t.covering("l_returnflag", "l_linenumber").where("l_returnflag = 'R'").select("l_returnflag", "n"))
on("sum_int", "lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem", lambda t: t.sum("l_linenumber"))
on("sum_float_where", "lineitem", "SELECT round(coalesce(sum(l_quantity), 0), 4) AS value FROM lineitem WHERE l_returnflag = 'R'", lambda t: t.sum("l_quantity", "l_returnflag,=,R").select(F.round("value", 4).alias("value")))
on("sum_empty_zero", "lineitem", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS value FROM lineitem WHERE l_quantity < 0", lambda t: t.sum("l_linenumber", "l_quantity,<,0"))
on("avg_all", "orders", "SELECT round(avg(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS value FROM orders", lambda t: Table(t.df.withColumn("o_totalprice", money("o_totalprice")), t.schema, t.key).avg("o_totalprice").select(F.round("value", 2).cast("double").alias("value")))
on("avg_where", "lineitem", "SELECT round(avg(l_quantity), 6) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20", lambda t: t.avg("l_quantity", "l_returnflag,=,R,AND,l_quantity,>,20").select(F.round("value", 6).alias("value")))
on("avg_empty_null", "orders", "SELECT avg(o_totalprice) AS value FROM orders WHERE o_totalprice < 0", lambda t: t.avg("o_totalprice", "o_totalprice,<,0"))
on("min_where", "part", "SELECT min(p_retailprice) AS value FROM part WHERE p_size > 10", lambda t: t.min("p_retailprice", "p_size,>,10"))
on("max_where", "part", "SELECT max(p_retailprice) AS value FROM part WHERE p_size <= 10", lambda t: t.max("p_retailprice", "p_size,<=,10"))
add("min_id", "SELECT min(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'O'", lambda s, d: Table(read(s, d, "orders").withColumn("key_value", F.col("o_orderkey")), TableSchema([("key_value", "int"), ("o_orderstatus", "string")]), "o_orderkey").min("key_value", "o_orderstatus,=,O"))
on("qbal_hits", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000", lambda t: t.balance_hits(5000, "c_acctbal").select("c_custkey", "c_acctbal"))
add("qbal_summary", "SELECT count(*) AS matched, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS total FROM customer WHERE c_acctbal >= 5000", lambda s, d: Table(read(s, d, "customer").withColumn("c_acctbal", money("c_acctbal")), TableSchema([("c_acctbal", "double")]), "c_custkey").balance_summary(5000, "c_acctbal").select("matched", F.col("total").cast("double").alias("total")))
on("covering_agg_table", "lineitem", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag", lambda t: t.covering("l_returnflag", "l_linenumber"))

# Pages.
PAGE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY "
on("page_offset_asc", "orders", PAGE + "o_totalprice, o_orderkey LIMIT 20 OFFSET 40", lambda t: t.page(3, 20, "o_totalprice").select("o_orderkey", "o_totalprice"))
on("page_offset_desc", "orders", PAGE + "o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40", lambda t: t.page(3, 20, "o_totalprice", True).select("o_orderkey", "o_totalprice"))
on("page_text_order", "orders", PAGE + "o_orderpriority DESC, o_orderkey LIMIT 15 OFFSET 15", lambda t: t.page(2, 15, "o_orderpriority", True).select("o_orderkey", "o_totalprice"))
on("page_last_partial", "supplier", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7 OFFSET 7", lambda t: t.page(2, 7).select("s_suppkey"))
on("page_keyset_asc", "orders", PAGE.replace("ORDER", "WHERE o_orderkey > 300 ORDER") + "o_orderkey LIMIT 25", lambda t: t.page_after(300, 25).select("o_orderkey", "o_totalprice"))
on("page_keyset_desc", "orders", PAGE.replace("ORDER", "WHERE o_orderkey < 300 ORDER") + "o_orderkey DESC LIMIT 25", lambda t: t.page_after(300, 25, True).select("o_orderkey", "o_totalprice"))
on("reorder_dense_ids", "customer", "SELECT c_custkey AS old_id, row_number() OVER (ORDER BY c_custkey) AS new_id FROM customer WHERE c_mktsegment = 'BUILDING'", lambda t: Table(t.where("c_mktsegment,=,BUILDING"), t.schema, t.key).dense_ids())

# Statistics and estimates.
on("column_stats", "orders", "SELECT count(o_orderpriority) AS non_null, count(DISTINCT o_orderpriority) AS distinct_values, min(o_orderpriority) AS min_text, max(o_orderpriority) AS max_text FROM orders", lambda t: stats.column_stats(t.df, "o_orderpriority"))
on("column_top3", "orders", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3", lambda t: stats.column_top(t.df, "o_orderpriority"))
on("column_histogram8", "orders", """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS place, count(*) OVER () AS total FROM orders)
SELECT CAST(floor(place * 8 / total) AS BIGINT) AS bucket, count(*) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY 1""", lambda t: stats.column_histogram(t.df, "o_custkey"))


def _share(t: Table, column: str, operator: str) -> DataFrame:
    """The estimate of ``stats`` for a condition on a column, from its number of distinct values."""
    distinct = stats.column_stats(t.df, column).first()["distinct_values"]
    return t.df.sparkSession.createDataFrame([(stats.selectivity(operator, distinct),)], "selectivity double")


on("eq_selectivity", "orders", "SELECT 1.0::DOUBLE / count(DISTINCT o_custkey) AS selectivity FROM orders", lambda t: _share(t, "o_custkey", "="))
on("range_selectivity", "orders", "SELECT least(0.5, greatest(4.0::DOUBLE / d, sqrt(1.0::DOUBLE / d))) AS selectivity FROM (SELECT count(DISTINCT o_orderpriority) AS d FROM orders)", lambda t: _share(t, "o_orderpriority", ">"))
on("scan_estimate", "orders", "SELECT count(*) * (0.08::DOUBLE * 0.45::DOUBLE) AS estimate FROM orders", lambda t: t.df.sparkSession.createDataFrame([(stats.blind_estimate(t.df.count(), parse_conditions("o_orderstatus,=,F,AND,o_totalprice,>,1000")),)], "estimate double"))

# Telemetry over events.
EVENT_STAGE = "percentile_disc(0.95)"
add("dist_stats_nearest_rank", "SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(CAST(value AS DECIMAL(18,2))), 4) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events", lambda s, d: report.distribution(read(s, d, "events"), "value", F.round(F.avg(money("value")), 4).cast("double")))
add("step_deltas_clamped", "SELECT event_id, event_type, CAST(greatest(coalesce(user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), 0), 0) AS BIGINT) AS delta FROM events", lambda s, d: report.step_deltas(read(s, d, "events"), "event_type", "event_id", "user_id").select("event_id", "event_type", "delta"))
add("window_delta_summary", "SELECT event_type, arg_min(user_id, event_id) AS first, arg_max(user_id, event_id) AS last, greatest(arg_max(user_id, event_id) - arg_min(user_id, event_id), 0) AS rise, max(user_id) AS most FROM events GROUP BY event_type", lambda s, d: report.window_delta(read(s, d, "events"), "event_type", "event_id", "user_id"))
add("telemetry_summary", """WITH h AS (SELECT arg_min(user_id, event_id) AS user_id_first, arg_max(user_id, event_id) AS user_id_last, max(user_id) AS user_id_most, min(event_id) AS event_id_first, max(event_id) AS event_id_last, max(event_id) AS event_id_most FROM events),
r AS (SELECT *, greatest(user_id_last - user_id_first, 0) AS user_id_rise, greatest(event_id_last - event_id_first, 0) AS event_id_rise FROM h)
SELECT *, CASE WHEN event_id_rise > 0 THEN user_id_rise::DOUBLE / event_id_rise ELSE 0.0::DOUBLE END AS users_per_event FROM r""", lambda s, d: report.summary(read(s, d, "events"), "event_id", ["user_id", "event_id"], {"users_per_event": ("user_id", "event_id")}))
add("trend_rollup", """WITH b AS (SELECT * FROM events WHERE event_type IN ('click', 'error')), l AS (SELECT * FROM b ORDER BY ts DESC, event_id DESC LIMIT 40),
r AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) AS rate FROM b),
m AS (SELECT count(user_id) AS user_id_n, min(user_id) AS user_id_low, max(user_id) AS user_id_high, round(avg(user_id), 6) AS user_id_mean, arg_max(user_id, (ts, event_id)) AS user_id_latest FROM l)
SELECT *, CASE WHEN rate < 0.2 OR user_id_latest > 1000000 THEN 'critical' WHEN rate < 0.9 OR user_id_latest > 10 THEN 'warning' ELSE 'healthy' END AS health FROM r, m""", lambda s, d: report.roll_up({t: read(s, d, "events").where(F.col("event_type") == t) for t in ("click", "error")}, "ts", "event_id", 40, ["user_id"], F.col("event_type") != "error", {"user_id": (10, 1_000_000)}, critical=0.2).withColumn("user_id_mean", F.round("user_id_mean", 6)))
add("trend_latest_n", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') ORDER BY ts DESC, event_id DESC LIMIT 40", lambda s, d: report.latest([read(s, d, "events").where("event_type = 'click'"), read(s, d, "events").where("event_type = 'view'")], "ts", "event_id", 40).select("event_id", "event_type"))
add("series_stats", "SELECT event_type, count(user_id) AS n, min(user_id) AS low, max(user_id) AS high, round(avg(user_id), 6) AS mean FROM events GROUP BY event_type", lambda s, d: report.series(read(s, d, "events"), "event_type", "user_id").withColumn("mean", F.round("mean", 6)))
add("pass_rate_health", "SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) AS rate, CASE WHEN count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) < 0.7 THEN 'critical' WHEN count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) < 0.9 THEN 'warning' ELSE 'healthy' END AS health FROM events", lambda s, d: report.pass_rate(read(s, d, "events"), F.col("event_type") != "error"))
STAGES = "SELECT event_type, quantile_disc(user_id, 0.95)::DOUBLE AS p95, max(user_id) AS most, quantile_disc(user_id, 0.95)::DOUBLE * 1000 + max(user_id) AS score FROM events {} GROUP BY event_type"
add("stage_ranking", f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, event_type) AS INTEGER) AS place FROM ({STAGES.format('')})", lambda s, d: report.rank_stages(read(s, d, "events"), "event_type", "user_id"))
add("stage_top_runs", f"""WITH a AS (SELECT event_type, CAST(row_number() OVER (ORDER BY score DESC, event_type) AS INTEGER) AS a FROM ({STAGES.format('WHERE event_id % 2 = 0')})),
b AS (SELECT event_type, CAST(row_number() OVER (ORDER BY score DESC, event_type) AS INTEGER) AS b FROM ({STAGES.format('WHERE event_id % 2 = 1')}))
SELECT event_type, a, b FROM a FULL JOIN b USING (event_type) WHERE least(coalesce(a, 99), coalesce(b, 99)) <= 2""", lambda s, d: report.top_stages({"a": read(s, d, "events").where("event_id % 2 = 0"), "b": read(s, d, "events").where("event_id % 2 = 1")}, "event_type", "user_id", 2))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("rate"), F.max("user_id").cast("double").alias("tail"))


add("profile_compare", """WITH p AS (SELECT event_type, count(*)::DOUBLE AS rate, max(user_id)::DOUBLE AS tail FROM events GROUP BY event_type), r AS (SELECT a.rate / b.rate AS rate_ratio, b.tail / a.tail AS tail_ratio FROM p a, p b WHERE a.event_type = 'click' AND b.event_type = 'view')
SELECT *, CASE WHEN rate_ratio >= 1.05 AND tail_ratio <= 1.15 THEN 'ok' ELSE 'warning' END AS verdict FROM r""", lambda s, d: report.compare(_profiles(s, d), "event_type", "click", "view", "rate", "tail"))
add("weighted_score", """WITH p AS (SELECT event_type, count(*)::DOUBLE AS score FROM events GROUP BY event_type), w AS (SELECT round(sum(score * w) / sum(w), 6) AS score FROM (SELECT score, CASE event_type WHEN 'click' THEN 3.0::DOUBLE WHEN 'view' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM p))
SELECT score, CASE WHEN score >= 95 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS tier FROM w""", lambda s, d: report.weighted_score(_profiles(s, d), "event_type", "rate", {"click": 3.0, "view": 2.0}).withColumn("score", F.round("score", 6)))


# Version logs, made of events: an id is a user, an error is a tombstone.
def event_log(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("_seq"), (F.col("event_type") == "error").alias("_deleted"))


def winners(s: SparkSession, d: str, seq: int | None = None) -> DataFrame:
    return latest(event_log(s, d), seq).where("not _deleted").select("id", "event_type", "value")


WINNERS = "SELECT user_id AS id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events {}) WHERE rn = 1 AND event_type <> 'error'"
HALF = "(SELECT max(event_id) // 2 FROM events)"


def half(s: SparkSession, d: str) -> int:
    return read(s, d, "events").agg(F.max("event_id")).first()[0] // 2


add("log_winners", WINNERS.format(""), winners)


def session_on(s: SparkSession, rows: DataFrame, key: str, name: str = "t") -> Session:
    """A session on a new table with the rows, in the shared folder."""
    session = Session(s, f"{files.shared_dir(s)}/workspace-{uuid.uuid4().hex}")
    session.workspace.create(name, TableSchema.of(rows.schema, key))
    session.set_table(name)
    if rows.columns != [key]:
        session.log().append(rows.withColumnRenamed(key, "id"))
    return session


def commit_events(session: Session, s: SparkSession, d: str, low: int, high: int) -> None:
    """Commit what the events of a range leave: the newest row of each id, then the tombstones."""
    newest = latest(event_log(s, d).where(F.col("_seq").between(low, high)))
    session.log().append(newest.where("not _deleted").select("id", "event_type", "value"))
    session.log().append(newest.where("_deleted").select("id"), deleted=True)


def _vacuumed(s: SparkSession, d: str) -> DataFrame:
    session, most = session_on(s, event_log(s, d).select("id", "event_type", "value").limit(0), "id"), 2 * half(s, d) + 1
    for i in range(3):
        commit_events(session, s, d, most * i // 3 + (i > 0), most * (i + 1) // 3)
    session.execute("VACUUM")
    return session.frame().withColumn("id", F.col("id").cast("long"))


def _isolations(s: SparkSession, d: str) -> DataFrame:
    """What a transaction reads at either isolation after another session has committed the later half."""
    reader, middle = session_on(s, event_log(s, d).select("id", "event_type", "value").limit(0), "id"), half(s, d)
    commit_events(reader, s, d, 0, middle)
    writer = Session(s, reader.workspace.root, "t")
    reader.execute("BEGIN")
    commit_events(writer, s, d, middle + 1, 2 * middle + 1)
    found = []
    for level in ("snapshot", "read_committed"):
        reader.execute(f"TXNISOLATION {level}")
        found.append(reader.frame().agg(F.lit(level).alias("isolation"), F.count(F.lit(1)).alias("n")))
    return found[0].unionAll(found[1])


add("vacuum_result", WINNERS.format(""), _vacuumed)
add("log_with_tombstones", WINNERS.format("").replace(" AND event_type <> 'error'", ""), lambda s, d: latest(event_log(s, d)).select("id", "event_type", "value"))
add("log_as_of_seq", WINNERS.format(f"WHERE event_id <= {HALF}"), lambda s, d: winners(s, d, half(s, d)))
add("log_history", "SELECT user_id AS id, event_id AS _seq, event_type = 'error' AS _deleted FROM events", lambda s, d: event_log(s, d).select("id", "_seq", "_deleted"))
add("read_committed_vs_snapshot", f"SELECT 'snapshot' AS isolation, count(*) AS n FROM ({WINNERS.format(f'WHERE event_id <= {HALF}')}) UNION ALL SELECT 'read_committed', count(*) FROM ({WINNERS.format('')})", _isolations)
add("storage_health", """WITH l AS (SELECT user_id AS id, count(*) AS n, count(*) FILTER (event_type = 'error') AS t, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)
SELECT CAST(sum(n) AS BIGINT) AS versions, CAST(sum(t) AS BIGINT) AS tombstones, count(*) FILTER (last <> 'error') AS live, sum(t)::DOUBLE / sum(n)::DOUBLE AS tombstone_ratio, (sum(n) - count(*) FILTER (last <> 'error'))::DOUBLE / sum(n)::DOUBLE AS dead_ratio FROM l""", lambda s, d: stats.storage_health(event_log(s, d)))


# Commands on a table of customers.
def _customers(s: SparkSession, d: str) -> Table:
    t = table(s, d, "customer")
    return Table(t.df.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), t.schema, t.key)


def _after(name: str, sql: str, *commands: str, columns: tuple[str, ...] = ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")) -> None:
    """The table after commands of a session; ``{first}`` stands for the least name."""

    def run(s: SparkSession, d: str) -> DataFrame:
        held = table(s, d, "customer").df.select(*columns)
        session = session_on(s, held, "c_custkey")
        first = held.agg(F.min("c_name")).first()[0] if any("{first}" in c for c in commands) else ""
        for command in commands:
            if (result := session.execute(command.replace("{first}", first))).code:
                raise RuntimeError(result.text)
        found = session.frame().withColumnRenamed("id", "c_custkey")
        kinds = {f.name: f.dataType for f in held.schema.fields}
        return found.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in found.columns))

    add(name, sql, run)


CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer"
_after("update_where", CUSTOMER.replace("c_mktsegment,", "CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment,"), "UPDATEWHERE(c_mktsegment, DEBT, WHERE, c_acctbal,<,0)")
_after("set_attr_multi", CUSTOMER.replace("c_mktsegment,", "CASE WHEN c_custkey IN (1, 5, 9) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment,"), "SETATTRMULTI(c_mktsegment, VIP, 1, 5, 9)")
_after("delete_where", CUSTOMER + " WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 0)", "DELETEWHERE(c_mktsegment,=,BUILDING,AND,c_acctbal,>,0)")
_after("delete_pk", CUSTOMER + " WHERE c_name <> (SELECT min(c_name) FROM customer)", "SET PRIMARY KEY(c_name)", "DELETEPK({first})")


def _inserted(s: SparkSession, d: str) -> DataFrame:
    """Suppliers inserted among the customers; those whose id is taken are left out."""
    held = _customers(s, d).df
    session = session_on(s, held, "c_custkey")
    session.insert_new(read(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")))
    return session.frame().select(F.col("id").cast("long").alias("c_custkey"), *held.columns[1:])


add("insert_dedup", CUSTOMER + " UNION ALL SELECT s_suppkey * 20, s_name, 'NEW', s_acctbal FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)", _inserted)


def _kept_summary(s: SparkSession, d: str) -> DataFrame:
    """Orders per status, kept after the first half of the events' ids was committed and extended by the second."""
    session = session_on(s, read(s, d, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").cast("int").alias("at")).limit(0), "id")
    middle = half(s, d)
    for low, high in ((0, middle), (middle + 1, 2 * middle + 1)):
        newest = latest(read(s, d, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").cast("int").alias("at"), F.col("event_id").alias("_seq")).where(F.col("_seq").between(low, high)))
        session.log().append(newest.drop("_seq"))
        found = session.summary("event_type", "at")
    if not session.counters["summaries_extended"]:
        raise RuntimeError("the summary was built anew")
    return found


add("covering_extended", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY event_type", _kept_summary)
BULK = TableSchema([("name", "string"), ("dept", "string"), ("age", "int"), ("salary", "int")])
BULK_SQL = "SELECT CAST(i AS INTEGER) AS id, 'u' || i AS name, CASE i % 4 WHEN 0 THEN 'ENG' WHEN 1 THEN 'FIN' WHEN 2 THEN 'OPS' ELSE 'HR' END AS dept, 20 + i % 40 AS age, 8000 + i % 50000 AS salary FROM range(1, 5001) t(i)"


def bulk(spark: SparkSession, n: int = 5000) -> Table:
    return Table(generated(spark.range(1, n + 1).select(F.col("id").cast("int").alias("id")), BULK), BULK)


add("bulk_insert_gen", BULK_SQL, lambda s, d: bulk(s).df)
add("bench_where_dept", f"SELECT * FROM ({BULK_SQL}) WHERE dept = 'ENG' AND age > 20", lambda s, d: bulk(s).where("dept,=,ENG,AND,age,>,20"))
add("bench_count_dept", f"SELECT count(*) FILTER (dept = 'ENG' AND age > 20) AS matched, count(*) AS total FROM ({BULK_SQL})", lambda s, d: bulk(s).count("dept,=,ENG,AND,age,>,20"))
add("bench_avg_dept", f"SELECT round(avg(salary), 6) AS value FROM ({BULK_SQL}) WHERE dept = 'ENG' AND age > 20", lambda s, d: bulk(s).avg("salary", "dept,=,ENG,AND,age,>,20").select(F.round("value", 6).alias("value")))
add("bench_or", f"SELECT * FROM ({BULK_SQL}) WHERE id = 2 OR dept = 'HR' OR name = 'Alice'", lambda s, d: bulk(s).where("id,=,2,OR,dept,=,HR,OR,name,=,Alice"))
_after("rename_attr", "SELECT c_custkey, c_name AS title, c_acctbal FROM customer", "RENATTR(c_name, title)", columns=("c_custkey", "c_name", "c_acctbal"))
_after("drop_attr", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer", "DELATTR(c_mktsegment)", columns=("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
_after("recover_across_rename", "SELECT c_custkey, c_name, c_acctbal FROM customer", "RENATTR(c_name, title)", "DELETEWHERE(c_acctbal,<,0)", "RECOVER TO LSN 1", columns=("c_custkey", "c_name", "c_acctbal"))
on("export_csv_rows", "nation", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation", lambda t: files.csv_rows(t.df, ["n_nationkey", "n_name", "n_regionkey"]))
on("export_json_rows", "nation", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":"' || n_regionkey || '"}' AS line FROM nation""", lambda t: files.json_rows(t.df, ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey"))


# Bag algebra.
def two(name: str, sql: str, left: str, right: str, query: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    add(name, sql, lambda s, d: query(read(s, d, left), read(s, d, right)))


two("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "orders", "customer", lambda o, c: algebra.theta_join(o, c.where("c_mktsegment = 'BUILDING'"), o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name"))
two("join_natural", "SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)", "nation", "region", lambda n, r: algebra.natural_join(n, r.withColumnRenamed("r_regionkey", "n_regionkey")).select("n_nationkey", "n_regionkey", "r_name"))
two("join_theta", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey", "nation", "region", lambda n, r: algebra.theta_join(n, r, n["n_regionkey"] < r["r_regionkey"]).select("n_nationkey", "r_regionkey"))
two("join_range", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_orderkey BETWEEN s_suppkey * 10 AND s_suppkey * 10 + 12", "orders", "supplier", lambda o, s: algebra.range_join(o, s.select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 12).alias("high")), "o_orderkey", "low", "high", 16).select("o_orderkey", "s_suppkey"))
two("cross_product", "SELECT n_nationkey, r_regionkey FROM nation, region", "nation", "region", lambda n, r: algebra.product(n, r).select("n_nationkey", "r_regionkey"))
two("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "customer", "orders", lambda c, o: algebra.semi_join(c, o.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey"))
two("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", "customer", "orders", lambda c, o: algebra.anti_join(c, o.where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey"))
for _side in ("left", "right", "full"):
    two(f"outer_{_side}", f"SELECT c_custkey, s_suppkey FROM customer {_side} JOIN (SELECT s_suppkey, s_suppkey * 20 AS k FROM supplier) ON c_custkey = k", "customer", "supplier", lambda c, s, side=_side: algebra.outer_join(c, s.withColumn("k", F.col("s_suppkey") * 20), F.col("c_custkey") == F.col("k"), side).select("c_custkey", "s_suppkey"))
for _name, _sql, _op in (("bag_union", "UNION ALL", algebra.bag_union), ("bag_intersect", "INTERSECT ALL", algebra.bag_intersect), ("bag_except", "EXCEPT ALL", algebra.bag_except), ("set_union", "UNION", algebra.set_union), ("set_intersect", "INTERSECT", algebra.set_intersect), ("set_except", "EXCEPT", algebra.set_except)):
    two(_name, f"SELECT c_nationkey AS k FROM customer {_sql} SELECT s_nationkey FROM supplier WHERE s_nationkey < 12", "customer", "supplier", lambda c, s, op=_op: op(c.select(F.col("c_nationkey").alias("k")), s.where("s_nationkey < 12").select(F.col("s_nationkey").alias("k"))))
on("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", lambda t: algebra.distinct(algebra.project(t.df, "l_returnflag", "l_linestatus")))
on("group_agg", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2", lambda t: algebra.group(t.df, ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"), F.max("l_quantity").alias("most")))
on("group_no_agg", "lineitem", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag", lambda t: algebra.group(t.df, ["l_returnflag"]))
on("sort_tau", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", lambda t: algebra.sort(t.df, F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal"))
on("select_sigma", "part", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9", lambda t: algebra.select(t.df, "p_size between 5 and 9").select("p_partkey"))
on("ext_projection", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 49", lambda t: algebra.project(t.where("l_quantity,>,49"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")))


# SQL surface.
def sql(name: str, statement: str, *tables: str) -> None:
    """A statement that both engines run as it stands."""
    def run(s: SparkSession, d: str) -> DataFrame:
        return s.sql(statement.format(**{t: "{" + t + "}" for t in tables}), **{t: read(s, d, t) for t in tables})

    add(name, statement.format(**{t: t for t in tables}), run)


sql("like_pattern", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'red%g_t'", "part")
sql("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})", "orders")
sql("from_subquery", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM {orders}) t GROUP BY k", "orders")
sql("correlated_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40)", "customer", "orders")
sql("nested_in3", "SELECT r_name FROM {region} WHERE r_regionkey IN (SELECT n_regionkey FROM {nation} WHERE n_nationkey IN (SELECT s_nationkey FROM {supplier}))", "region", "nation", "supplier")
sql("view_expand", "WITH v AS (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) SELECT n_name, n FROM v JOIN {nation} ON c_nationkey = n_nationkey WHERE n > 3", "customer", "nation")
