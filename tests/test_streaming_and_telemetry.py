import json

from pyspark.sql import functions as F

from tidemark.operators import report
from tidemark.sources import telemetry
from tidemark.sources.log import Log
from tidemark.sources.schema import TableSchema
from tidemark.streaming.upsert import upsert_stream, windowed_counts


def test_stream_of_changes_into_a_log(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    schema = "id int, name string, at long, gone boolean"
    spark.createDataFrame([(1, "a", 1, False), (2, "b", 2, False), (1, "c", 3, False)], schema).coalesce(1).write.parquet(source)
    log = Log(spark, f"file://{tmp_path}/t").create(TableSchema([("name", "string")]))
    for _ in range(2):
        query = upsert_stream(spark.readStream.schema(schema).parquet(source), log, "at", f"file://{tmp_path}/cp", "gone").trigger(availableNow=True).start()
        query.awaitTermination(60)
        spark.createDataFrame([(2, "b", 4, True)], schema).coalesce(1).write.mode("append").parquet(source)
    assert [(r.id, r.name) for r in log.current().collect()] == [(1, "c")]


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:12:00", "y")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in windowed_counts(rows, "t", "k").collect()) == [1, 2]


def test_telemetry_source(spark, tmp_path):
    good = {"schema_version": "v1", "ts_ms": 5, "run_id": "r", "label": "before_x", "stats": {"a": 3, "b": 1}}
    bad = good | {"ts_ms": 9, "label": "after_x", "stats": {"a": -1}}
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join([json.dumps(good), json.dumps(bad), "not json"]))
    rows = telemetry.read(spark, f"file://{path}", ["a", "b"]).cache()
    found = telemetry.violations(rows, "v1", ["a", "b"]).orderBy("ts_ms").collect()
    assert "unreadable" in found[0].problems and found[1].problems == ["stats.a", "stats.b"]
    filled = telemetry.with_defaults(rows, {"b": 7})
    assert telemetry.violations(filled, "v1", ["b"]).count() == 1 and filled.where("ts_ms = 5").first().stats.b == 1
    assert telemetry.pick(rows, label_prefix="before").count() == 1 and telemetry.pick(rows, last=1).first().ts_ms == 9


def test_report_shapes(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 1, 7)], "run string, t int, c int")
    assert [r.delta for r in report.step_deltas(rows, "run", "t", "c").orderBy("run", "t").collect()] == [0, 0, 0]
    assert report.window_delta(rows, "run", "t", "c").where("run = 'a'").first().rise == 0
    assert report.pass_rate(rows, F.col("c") > 5).first().health == "critical"
    assert report.weighted_score(rows, "run", "c", {"a": 1.0}).first().tier == "D"
