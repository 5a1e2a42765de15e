import datetime as dt

import pytest

from tidemark.errors import InvalidArgument
from tidemark.functions.types import parse, type_name
from tidemark.operators.predicate import aggregate_arguments, closed_range, compile_conditions, fingerprint, parse_conditions, split_arguments
from tidemark.operators.query import Table
from tidemark.sources.schema import TableSchema

SF = "/root/testdata/sf0.001"


def test_arguments_keep_quoted_commas():
    assert split_arguments('a, "b, c", d') == ["a", "b, c", "d"]
    assert split_arguments("  ") == []


@pytest.mark.parametrize("bad", ["a", "a,=", "a,~,1", "a,=,1,XOR,b,=,2", "a,=,1,AND,b", "a,=,1,AND,b,~,2"])
def test_bad_conditions_are_rejected(bad):
    with pytest.raises(InvalidArgument):
        parse_conditions(bad)


def test_fold_is_left_to_right(spark):
    df = spark.createDataFrame([(1, 5, 20), (2, 1, 20), (3, 5, 1)], "id int, a int, b int")
    t = Table.from_dataframe(df)
    ids = lambda c: sorted(r.id for r in t.where(c).collect())
    assert ids("a,=,5,AND,b,>,10") == [1]
    assert ids("a,=,5,OR,b,>,10") == [1, 2, 3]
    assert ids("a,=,1,OR,a,=,5,AND,b,>,10") == [1, 2]
    assert ids("id,>=,2,AND,id,<=,3") == [2, 3]
    assert ids("") == [1, 2, 3]


def test_nulls_and_text_numbers(spark):
    df = spark.createDataFrame([(1, "05", None), (2, "x", "u"), (3, None, "hello world")], "id int, n string, note string")
    t = Table(df, TableSchema([("n", "int"), ("note", "string")]))
    assert [r.id for r in t.where("n,=,5").collect()] == [1]
    assert [r.id for r in t.where("n,!=,7").collect()] == [1]
    assert [r.id for r in t.where("note,contains,world").collect()] == [3]
    with pytest.raises(InvalidArgument):
        t.where("id,=,not_int")
    empty = compile_conditions(parse_conditions("note,!=,u"), t.schema, df.schema, missing_as_empty=True)
    assert sorted(r.id for r in df.where(empty).collect()) == [1, 3]


def test_filters_reach_the_scan(spark):
    plan = Table.from_dataframe(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderkey").where("o_orderstatus,=,F,AND,o_totalprice,>,1000").select("o_orderkey")
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_total" in text


def test_types():
    assert type_name("Integer") == "int" and type_name("STR") == "string"
    assert parse("yes", "bool") is True and parse("0", "bool") is False
    assert parse("2024-02-29", "date") == dt.date(2024, 2, 29)
    for text, kind in (("maybe", "bool"), ("xx", "char"), ("12abc", "int"), ("2024-99-99", "date"), ("1e", "double")):
        with pytest.raises(InvalidArgument):
            parse(text, kind)


def test_ranges_arguments_fingerprints():
    schema = TableSchema([("a", "int"), ("b", "string")])
    assert closed_range(parse_conditions("a,>=,3,AND,a,<=,9,AND,a,>=,4"), schema) == ("a", 4, 9)
    assert closed_range(parse_conditions("a,>=,3,OR,a,<=,9"), schema) is None
    assert aggregate_arguments("a, WHERE, b, =, x")[1] == parse_conditions("b,=,x")
    assert fingerprint(parse_conditions("a,=,1")) != fingerprint(parse_conditions("a,=,2"))


def test_schema_round_trip_and_fallbacks():
    s = TableSchema([("email", "string"), ("age", "int")], "email", "acct")
    assert TableSchema.from_json(s.to_json()) == s
    assert TableSchema.from_json('{"attributes": [["a", "int"], ["b", "blob"]], "primary_key": "b"}') == TableSchema([("a", "int")])
    assert TableSchema([("x", "int"), ("balance", "int")]).numeric_attribute() == "balance"
    with pytest.raises(InvalidArgument):
        TableSchema.parse(["a:int", "a:int"])
