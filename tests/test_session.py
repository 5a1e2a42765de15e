import json

import pytest

from tidemark.errors import Blocked
from tidemark.operators.predicate import parse_conditions
from tidemark.plans import explain
from tidemark.plans.explain import Governor, estimate
from tidemark.session import Session, inverse

PEOPLE = ["DEFATTR(name:string, age:int)", "CREATE TABLE(people)"]


def run(session, *lines):
    for line in lines:
        result = session.execute(line)
        assert result.code == 0, (line, result.text)
    return result


def ids(result):
    return sorted(r.id for r in result.df.collect())


@pytest.fixture
def people(session):
    run(session, *PEOPLE, "INSERT(1, Alice, 10)", "INSERT(2, Bob, 20)")
    return session


def test_insert_find_count_and_duplicates(people):
    assert run(people, "COUNT").text == "2"
    assert run(people, "COUNT(age,>,15)").text == "1 / 2"
    assert ids(run(people, "FIND(2)")) == [2]
    assert people.execute("INSERT(1, Eve, 5)").code == 4
    assert people.execute("FIND(9)").code == 3
    assert people.execute("WHERE(age,~,1)").code == 2
    assert people.execute("NOSUCH(1)").code == 2
    assert run(people, 'INSERT(3, "a, b")', "FIND(3)").df.first().age == 0


def test_aggregates(people):
    assert run(people, "SUM(age)").text == "30"
    assert run(people, "AVG(age, WHERE, name, =, Bob)").text == "20.000000"
    assert run(people, "AVG(age, WHERE, name, =, Nobody)").text == "no numeric rows"
    assert run(people, "MIN(age)").text == "10" and run(people, "MAX(age)").text == "20"
    assert run(people, "SUM(age, WHERE, name, =, Nobody)").text == "0"
    assert people.execute("SUM(name)").code == 2
    assert "matched 1 total 20" in run(people, "QBAL(15)").text


def test_updates_deletes_and_history(people):
    run(people, "UPDATEWHERE(age, 77, WHERE, id, =, 1)", "SETATTR(2, name, Rob)", "SETATTRMULTI(age, 5, 1, 2)")
    assert run(people, "COUNT(age,=,5)").text == "2 / 2"
    assert people.execute("SETATTRMULTI(age, 6, 1, 99)").code == 3
    assert run(people, "COUNT(age,=,5)").text == "2 / 2"
    run(people, "UPDATE(1, Al, 1)", "DELETE(2)")
    assert run(people, "COUNT").text == "1"
    assert run(people, "SCAN").df.count() == 8
    health = run(people, "SHOW STORAGE").df.first()
    assert (health.versions, health.tombstones, health.live) == (8, 1, 1)
    assert people.workspace.vacuum_queue() == [("people", 7 / 8)]
    run(people, "VACUUM")
    assert run(people, "SCAN").df.count() == 1 and run(people, "COUNT").text == "1"
    assert run(people, "DELETEWHERE(age,>=,0)").text == "deleted 1"
    assert people.execute("DELETE(1)").code == 3


def test_primary_key(people):
    run(people, "SET PRIMARY KEY(name)")
    assert people.execute("INSERT(3, Bob, 1)").code == 4
    assert people.execute("UPDATEWHERE(name, Bob, WHERE, id, =, 1)").code == 4
    assert ids(run(people, "FINDPK(Bob)")) == [2]
    run(people, "DELETEPK(Bob)")
    assert people.execute("FINDPK(Bob)").code == 3
    assert run(people, "SHOW KEY").text == "name"


def test_transactions_and_savepoints(people):
    run(people, "BEGIN", "UPDATEWHERE(age, 77, WHERE, id, =, 1)", "SAVEPOINT s", "DELETE(2)")
    assert run(people, "COUNT").text == "1"
    run(people, "ROLLBACK TO s")
    assert run(people, "COUNT").text == "2"
    run(people, "RELEASE SAVEPOINT s", "COMMIT")
    assert run(people, "COUNT(age,=,77)").text == "1 / 2"
    run(people, "BEGIN", "SETATTRMULTI(age, 99, 1, 2)", "INSERT(3, Zed, 3)", "ROLLBACK")
    assert run(people, "COUNT(age,=,99)").text == "0 / 2"
    assert people.execute("COMMIT").code == 5
    run(people, "BEGIN")
    assert people.execute("BEGIN").code == 5
    assert people.execute("VACUUM").code == 5


def test_isolation_and_conflicts(people, spark):
    other = Session(spark, people.workspace.root, "people")
    run(people, "BEGIN")
    run(other, "INSERT(3, Carl, 30)")
    assert run(people, "COUNT").text == "2"
    run(people, "TXNISOLATION read_committed")
    assert run(people, "COUNT").text == "3"
    run(people, "TXNISOLATION snapshot", "UPDATEWHERE(age, 1, WHERE, id, =, 1)", "COMMIT")
    assert run(people, "COUNT").text == "3" and run(people, "COUNT(age,=,1)").text == "1 / 3"
    run(people, "BEGIN", "UPDATEWHERE(age, 2, WHERE, id, =, 2)")
    run(other, "UPDATEWHERE(age, 3, WHERE, id, =, 2)")
    assert people.execute("COMMIT").code == 4
    run(people, "ROLLBACK")
    assert run(people, "COUNT(age,=,3)").text == "1 / 3"


def test_recovery_to_a_point(people):
    seq = people.log().manifest()["seq"]
    run(people, "INSERT(3, Late, 1)", "DELETE(1)", "VACUUM", f"RECOVER TO LSN {seq}")
    assert ids(run(people, "WHERE(id,>,0)")) == [1, 2]
    run(people, "INSERT(9, After, 1)")
    assert run(people, "COUNT").text == "3"


def test_pages(people):
    run(people, "INSERT(3, Cid, 20)", "INSERT(4, Dan, 5)")
    page = lambda line: [r.id for r in run(people, line).df.collect()]
    assert page("PAGE(1, 2, age, desc)") == [2, 3] and page("PAGE(2, 2, age, desc)") == [1, 4]
    assert page("PAGE(1, 2, id, asc, after=2)") == [3, 4] and page("PAGE(1, 2, desc, after=3)") == [2, 1]
    assert people.execute("PAGE(0, 2)").code == 2 and people.execute("PAGE(9, 2)").code == 2
    assert json.loads(people.page_json(1, 1))["rows"] == [{"id": 1, "name": "Alice", "age": 10}]


def test_definition(people):
    run(people, "RENATTR(age, years)")
    assert run(people, "SUM(years)").text == "30"
    run(people, "VACUUM", "DELATTR(years)")
    assert "years" not in run(people, "SHOW ATTR").text and run(people, "COUNT").text == "2"
    assert people.execute("SET PRIMARY KEY(nothing)").code == 2
    run(people, "CREATE SCHEMA(hr)", "ALTER TABLE people SET SCHEMA(hr)")
    assert run(people, "LIST SCHEMAS").text == "hr 1" and people.execute("DROP SCHEMA(hr)").code == 4
    run(people, "ALTER TABLE people REMOVE SCHEMA", "DROP SCHEMA(hr)", "RENAME TABLE(folk)")
    assert run(people, "SHOW TABLES").text == "* folk (schema)"
    run(people, "RESET")
    assert run(people, "COUNT").text == "0"
    run(people, "DROP TABLE(folk)")
    assert people.execute("COUNT").code == 3


def test_bulk_reorder_and_statistics(session):
    run(session, "DEFATTR(name:string, dept:string, age:int, salary:int)", "CREATE TABLE(bulk)")
    assert run(session, "BULKINSERT(10, 100)").text == "inserted 100"
    assert run(session, "BULKINSERT(100, 20)").text == "inserted 10"
    assert run(session, "BULKINSERTFAST(200, 10, ENG)").text == "inserted 10"
    row = run(session, "FIND(13)").df.first()
    assert (row.name, row.dept, row.age, row.salary) == ("u13", "FIN", 33, 8013)
    run(session, "CONFIRM_REORDER")
    assert ids(run(session, "WHERE(id,>,0)")) == list(range(1, 121))
    assert {r.dept: r.n for r in session.summary("dept", "salary").collect()}["ENG"] == run(session, "WHERE(dept,=,ENG)").df.count()
    run(session, "DELETEWHERE(dept,=,HR)")
    assert {r.dept for r in session.summary("dept", "salary").collect()} == {"ENG", "FIN", "OPS"}
    run(session, "RECOVER TO LSN 4")
    held = session.analyze()
    assert held["rows"] == 120 and held["columns"]["dept"]["distinct"] == 4
    plan = json.loads(run(session, "SHOW PLAN(dept,=,ENG,AND,age,>,20)").text)
    assert plan["plan_id"] == "and_seed_filter" and plan["candidates"][0]["reason"] == "from statistics"
    assert "plan eq_sidecar" in run(session, "EXPLAIN WHERE(dept,=,ENG)").text


def test_export_and_import(people, spark, tmp_path):
    run(people, 'INSERT(3, "say ""x"", y", 1)', f"EXPORT CSV file://{tmp_path}/c", f"EXPORT JSON file://{tmp_path}/j")
    lines = [p for p in (tmp_path / "c").glob("part-*")][0].read_text().splitlines()
    assert lines[:2] == ["id,name,age", "1,Alice,10"] and len(lines) == 4
    data = json.loads([p for p in (tmp_path / "j").glob("part-*")][0].read_text())
    assert data[0] == {"id": 1, "name": "Alice", "age": "10"} and len(data) == 3
    assert people.execute("EXPORT csv x").code == 2
    other = Session(spark, f"file://{tmp_path}/other")
    assert run(other, f"IMPORTDIR({people.workspace.root})").text == "people imported"
    assert run(other, f"IMPORTDIR({people.workspace.root})").text == "people skipped"
    assert run(other, "USE(people)", "COUNT").text == "3"


def test_databases(people):
    people.workspace.create_database("db1")
    assert people.workspace.databases() == ["db1"] and people.workspace.database("db1").tables() == []
    people.workspace.drop_database("db1")
    assert people.workspace.databases() == []


def test_governor_and_settings(people):
    people.governor.mode, people.governor.least_rows = "reject", 1
    assert people.execute("WHERE(age,>,1)").code == 6
    assert people.execute("WHERE(id,=,1)").code == 0
    assert run(people, "AUTOVACUUM 3").text == "AUTOVACUUM 3"
    state = json.loads(run(people, "SCANPOLICY(ratelimit, least_rows=1, cap=1, per_second=0)").text)
    assert state["rejected"] == 1 and state["checks"] == 2 and run(people, "WHERE(age,>,1)").df.count() == 2
    assert json.loads(run(people, "SCANPOLICY(ratelimit, budget=1)").text)["budget"] == 1
    assert "too wide" in people.execute("WHERE(age,>,1)").text and people.governor.budget_bound == 1
    assert people.execute("SCANPOLICY(sometimes)").code and people.execute("SCANPOLICY(off, cap=2)").code
    run(people, "SCANPOLICY off")
    run(people, "INSERT(5, E, 1)", "INSERT(6, F, 1)")
    assert people.counters["compactions"] >= 1 and run(people, "COUNT").text == "4"
    assert json.loads(run(people, "SHOW STATUS JSON").text)["AUTOVACUUM"] == "3"


def test_scan_caps_and_estimates(people):
    wide, either = parse_conditions("age,>,1"), parse_conditions("age,>,1,OR,age,<,0,AND,name,!=,x,AND,age,>,2")
    guard, schema = Governor(), people.log().schema()
    assert [guard.most_rows(wide, n) for n in (1_000, 100_000, 300_000, 1_000_000)] == [850, 78_000, 210_000, 600_000]
    assert guard.most_rows(either, 1_000_000) == 405_000
    stats = {"columns": {"age": {"distinct": 100}, "name": {"distinct": 4}}}
    one = lambda text: estimate(parse_conditions(text), schema, 1000, stats)
    assert (one("age,=,1"), one("age,>,1"), one("age,!=,1"), one("name,contains,x"), one("id,=,1")) == (10, 100, 490, 450, 1)
    assert one("age,=,1,AND,name,=,x") == 2.5 and one("age,=,1,OR,name,=,x") == 260
    assert estimate(wide, schema, 1000) == 450


def test_session_history(people):
    history, first = people.history, people.keep_history("shell")
    run(people, "COUNT", "WHERE(age,>,1)\n")
    people.execute("NONSENSE")
    assert history.commands(first) == ["COUNT", "WHERE(age,>,1)", "NONSENSE"] and history.info(first)["ended"] is None
    people.close()
    other = Session(people.spark, people.workspace.root, "people")
    assert other.keep_history("batch") == first + 1 and other.history.info(first)["ended"] and other.history.info(9) is None
    assert history.cleanup(1) == [] and history.cleanup(-1) == [first] and history.sessions() == [first + 1]
    assert other.workspace.tables() == ["people"] and run(other, "COUNT").text == "2"


def test_storage_bytes(people):
    run(people, "SETATTR(1, age, 3)", "DELETE(2)")
    held = run(people, "SHOW STORAGE").df.first()
    assert held.data_bytes == people.log().size() > 0 and held.dead_bytes + held.live_bytes == held.data_bytes
    assert held.dead_ratio == 0.75 and abs(held.fragmentation_ratio - 0.75) < 0.01


def test_rate_limit(people, monkeypatch):
    guard, schema = Governor("ratelimit", 1, per_second=1, cap=1), people.log().schema()
    clock = iter((0.0, 0.5, 1.2))
    monkeypatch.setattr(explain.time, "monotonic", lambda: next(clock))
    guard.admit(parse_conditions("age,>,1"), schema, 10)
    with pytest.raises(Blocked, match="policy_block"):
        guard.admit(parse_conditions("age,>,1"), schema, 10)
    guard.admit(parse_conditions("age,>,1"), schema, 10)


def test_summary_is_extended(people):
    want = lambda: sorted((r.name, r.n, r.total) for r in people.table().covering("name", "age").collect())
    found = lambda: sorted((r.name, r.n, r.total) for r in people.summary("name", "age").collect())
    assert found() == want()
    run(people, "INSERT(3, Bob, 5)", "UPDATE(1, Bob, 11)", "DELETE(2)", "INSERT(4, Eve, 1)", "SETATTR(4, age, 8)")
    assert found() == want() == [("Bob", 2, 16), ("Eve", 1, 8)] and people.counters["summaries_extended"] == 1
    run(people, "VACUUM", "DELETE(4)")
    assert found() == want() and people.counters["summaries_extended"] == 1


def test_inverse():
    row = {"id": 1, "name": "Al", "age": 3}
    assert inverse("INSERT(1, Al, 3)") == "DELETE(1)"
    assert inverse("DELETE(1)", row) == "INSERT(1, Al, 3)"
    assert inverse("SETATTR(1, age, 9)", row) == "SETATTR(1, age, 3)"
    assert inverse("RENATTR(a, b)") == "RENATTR(b, a)"
    assert inverse("COUNT") is None


def test_scripts_and_command_line(spark, tmp_path):
    import io

    from tidemark.cli import main

    script = tmp_path / "s.mdb"
    script.write_text("# people\nDEFATTR(name:string)\nCREATE TABLE(t)\nINSERT(1, A)\nCOUNT\n")
    out = io.StringIO()
    assert main(["--data-dir", f"file://{tmp_path}/cli", "--run-mdb", str(script)], spark, out) == 0
    assert out.getvalue().splitlines()[-1] == "1"
    out = io.StringIO()
    assert main(["--data-dir", f"file://{tmp_path}/cli", "--table", "t", "--page", "1", "5", "--page-json"], spark, out) == 0
    assert json.loads(out.getvalue())["rows"] == [{"id": 1, "name": "A"}]
    assert main(["--data-dir", f"file://{tmp_path}/cli", "--table", "t", "--exec", "FIND(7)"], spark, out) == 3


def test_unpublished_writes_are_invisible(people):
    log = people.log()
    log.stage(log.current(), log.schema(), 99)
    assert run(people, "COUNT").text == "2"


def test_recovery_across_a_renamed_attribute(session):
    run(session, "DEFATTR(name:string, age:int)", "CREATE TABLE(t)", "INSERT(1, Al, 30)", "INSERT(2, Bo, 40)", "RENATTR(name, title)", "INSERT(3, Cy, 50)")
    assert [tuple(r) for r in session.frame().orderBy("id").collect()] == [(1, "Al", 30), (2, "Bo", 40), (3, "Cy", 50)]
    run(session, "RECOVER TO LSN 2")
    assert session.frame().columns == ["id", "name", "age"] == ["id", *session.log().schema().names]
    assert [tuple(r) for r in session.frame().orderBy("id").collect()] == [(1, "Al", 30), (2, "Bo", 40)]
    run(session, "DELATTR(age)", "INSERT(4, Di)", "RECOVER TO LSN 2", "INSERT(5, Ed, 60)")
    assert [tuple(r) for r in session.frame().orderBy("id").collect()] == [(1, "Al", 30), (2, "Bo", 40), (5, "Ed", 60)]
    assert {r["name"] for r in session.scan(None, []).df.collect()} == {"Al", "Bo", "Ed"}


def test_read_committed_keeps_own_writes_on_top(people, spark):
    other = Session(spark, people.workspace.root, "people")
    run(people, "TXNISOLATION rc", "BEGIN", "SETATTR(1, age, 99)")
    run(other, "SETATTR(1, age, 77)", "SETATTR(1, age, 78)", "SETATTR(2, age, 11)", "VACUUM")
    assert {r.id: r.age for r in people.frame().collect()} == {1: 99, 2: 11}
    run(people, "TXNISOLATION snapshot")
    assert {r.id: r.age for r in people.frame().collect()}[2] != 11
    assert people.execute("COMMIT").code != 0
    run(people, "ROLLBACK")
    assert {r.id: r.age for r in people.frame().collect()} == {1: 78, 2: 11}


def test_vacuum_queue_and_leftovers(people):
    log = people.log()
    folder = log.stage(log.current(), log.schema(), 99)
    run(people, "SETATTR(1, age, 1)", "SETATTR(1, age, 2)", "SETATTR(1, age, 3)")
    assert people.workspace.vacuum_queue()[0][1] >= 0.2
    assert run(people, "VACUUM QUEUE").text == "compacted people" and not log.manifest()["deltas"]
    assert run(people, "VACUUM QUEUE").text == "" and log.sweep() == []
    assert log.sweep(0) == [folder] and run(people, "COUNT").text == "2"


def test_key_and_label_are_published_with_the_data(people):
    run(people, "SET PRIMARY KEY(name)")
    log = people.log()
    assert log.manifest()["schema"] and log.schema().primary_key == "name" and log.schema(log.manifest(1)).primary_key == "id"
    run(people, "INSERT(3, Zoe, 5)", "VACUUM")
    assert log.schema().primary_key == "name"
