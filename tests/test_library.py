import datetime as dt
import os
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline import catalogue
from weftline.functions.rules import rules_filter
from weftline.functions.types import unique_names
from weftline.operators import combine
from weftline.operators.apply import apply
from weftline.operators.combine import lookup_join, project
from weftline.plans import spec as plan
from weftline.sinks.writers import write_jdbc
from weftline.sources import sql
from weftline.sources.mail import mail_events
from weftline.streaming import feed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        p = f"{SF}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(r[c] for c in columns) for r in df.collect()), key=str)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    assert got == sorted(map(plain, want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


def test_whole_joins_keep_every_customer(spark):
    keys = {r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    for name in ("join_left_whole", "join_full_whole", "lookup_full_whole"):
        assert {r.id for r in catalogue.QUERIES[name](spark, SF).collect()} >= keys


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


EVENT = "id int, amount string, price double, tags map<string,string>, inner struct<deep:int>, js string"
ROWS = [(1, "100", 10.0, {"a": "x"}, (5,), '{"k": {"z": 7}}'), (2, "abc", None, None, None, None), (3, "100.0", 100.0, {}, (None,), "{}")]


@pytest.mark.parametrize(
    "condition,ids",
    [
        (("amount", "eq", "100"), [1]), (("amount", "eq", 100.0), [1]), (("price", "eq", 100), [3]), (("amount", "neq", "abc"), [1, 3]),
        (("price", "neq", 10), [2, 3]), (("price", "lt", 5), [2]), (("price", "gt", 50), [3]), (("amount", "gt", 99), [1, 3]),
        (("amount", "contains", "0"), [1, 3]), (("none", "contains", "n"), []), (("amount", "startsWith", "a"), [2]), (("amount", "endsWith", "0"), [1, 3]),
        (("amount", "regex", "b"), [2]), (("amount", "regex", "("), []), (("price", "exists", None), [1, 3]), (("price", "notExists", None), [2]),
        (("tags.a", "eq", "x"), [1]), (("inner.deep", "gt", 4), [1]), (("js.k.z", "eq", "7"), [1]), (("inner.none", "notExists", None), [1, 2, 3]),
        (("amount", "in", ["abc", "100"]), [1, 2]), (("amount", "in", "abc"), []), (("none", "notIn", ["a"]), [1, 2, 3]), (("amount", "like", "a"), []),
    ],
)
def test_rules(spark, condition, ids):
    df = spark.createDataFrame(ROWS, EVENT)
    rule = [{"all": [dict(zip(("field", "op", "value"), condition))]}]
    assert sorted(r.id for r in rules_filter(df, rule).collect()) == ids


def test_lookup_keeps_last_and_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, k string")
    b = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("x", None, "none"), (None, 1, "null")], "k string, n int, v string")
    columns = [{"name": "id", "ref": "A.id"}, {"name": "v", "ref": "B.v"}]
    got = project(lookup_join(a, b, ["k"], ["k"], "inner", order_by=["n"]), columns)
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (2, "null")]
    every = project(lookup_join(a, b, ["k"], ["k"], "inner", match="all"), columns)
    assert every.count() == 4


def test_write_modes_ignore_null_keys(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    s = spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], "k int, v string")
    key = lambda r: (r[0] is None, r)
    rows = lambda m: sorted(map(tuple, apply(t, s, m, ["k"]).collect()), key=str)
    assert rows("update") == sorted([(1, "c"), (None, "b")], key=str)
    assert rows("merge") == sorted([(1, "c"), (2, "e"), (None, "b"), (None, "d")], key=str)
    assert rows("delete") == [(None, "b")]
    assert key
    with pytest.raises(ValueError):
        apply(t, s, "INSERTED")
    with pytest.raises(ValueError):
        apply(t, s, "merge", [])
    double = spark.createDataFrame([(1, "c"), (1, "d")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        apply(t, double, "merge", ["k"], on_duplicate="error").collect()


def test_names_watermarks_and_ties(spark):
    assert unique_names(["id", "ID", "id2", "id"]) == ["id", "ID3", "id2", "id4"] or unique_names(["id", "id", "id"]) == ["id", "id2", "id3"]
    df = spark.createDataFrame([(i // 3,) for i in range(12)], "w int")
    assert sql.poll_increment(df, "w", "0", batch=4).count() == 4
    assert sql.poll_increment(df, "w", "0", batch=4, include_ties=True).count() == 6
    assert sql.encode_watermark(dt.datetime(2024, 1, 1, 0, 0, 0, 5), "timestamp").endswith("000005")
    with pytest.raises(ValueError):
        sql.identifier("a; drop")


def test_spec_errors(spark):
    with pytest.raises(ValueError):
        plan.validate({"nodes": []})
    with pytest.raises(ValueError):
        plan.validate({"nodes": [{"id": "a", "type": "log"}]})


@pytest.mark.parametrize(
    "pattern,ids", [(r"^\p{L}+$", [2]), (r"(?P<x>a)b", [2]), (r"\d{3}\z", [1]), (r"(?P<x", []), ("*", []), ("[", []), (r"\(?P", [])],
)
def test_regex_rules_and_subjects(spark, pattern, ids):
    """Java judges a pattern and runs it; an invalid one matches nothing."""
    df = spark.createDataFrame(ROWS, EVENT)
    assert sorted(r.id for r in rules_filter(df, [{"all": [{"field": "amount", "op": "regex", "value": pattern}]}]).collect()) == ids
    assert sorted(r.id for r in mail_events(df.selectExpr("id AS uid", "id", "amount AS subject"), subject=pattern).collect()) == ids


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def derby(folder):
    return {"url": f"jdbc:derby:{folder}/db;create=true", "driver": DERBY}


def test_jdbc_round_trip(spark, tmp_path):
    link = derby(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    write_jdbc(df, "things", link)
    got = sql.sql_source(spark, 'SELECT "id", "name" FROM things WHERE "id" > 1;', link)
    assert [tuple(r) for r in got.collect()] == [(2, "b")]
    parts = link | {"partitionColumn": '"id"', "lowerBound": 0, "upperBound": 4, "numPartitions": 2, "batch_size": 10}
    assert sql.sql_source(spark, "SELECT * FROM things", parts).count() == 2
    write_jdbc(df, "things", link, "truncate")
    assert sql.sql_source(spark, "SELECT * FROM things", link).count() == 0


def test_jdbc_update_merge_delete(spark, tmp_path):
    """Each mode over JDBC leaves what the pure function of the mode computes; nothing but the table stays behind."""
    link = derby(tmp_path)
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "n", 0.0)], "id int, name string, x double")
    new = spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (9, "I", 1), (None, "N", 1)], "id int, name string, seq int")
    for mode in ("update", "merge", "delete"):
        write_jdbc(old, f"t_{mode}", link)
        extra = {} if mode == "delete" else {"order_by": ["seq"]}
        write_jdbc(new, f"t_{mode}", link, mode, keys=["id"], columns=["id", "name"], **extra)
        got = sql.sql_source(spark, f"SELECT * FROM t_{mode}", link).collect()
        want = apply(old, new, mode, ["id"], ["id", "name"], **extra).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    with pytest.raises(ValueError):
        write_jdbc(new, "t_update", link, "update", keys=[])
    with pytest.raises(Exception):  # rolled back, and the staging table goes
        write_jdbc(new.withColumn("name", F.lit("x" * 300)), "t_merge", link | {"schema": "nowhere"}, "merge", keys=["id"])
    left = sql.sql_source(spark, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", link).collect()
    assert sorted(r[0] for r in left) == ["T_DELETE", "T_MERGE", "T_UPDATE"]


def test_default_schemas():
    assert [sql.default_schema({"type": t, "database": "d"}) for t in ("postgres", "sqlserver", "mysql")] == ["public", "dbo", "d"]
    option = lambda **c: sql.jdbc_options({"host": "h", "database": "d"} | c)
    assert option(type="postgres", schema="s")["sessionInitStatement"] == "SET search_path TO s"
    assert option(type="mysql", schema="s")["sessionInitStatement"] == "USE s"
    assert option(type="sqlserver", schema="dbo")["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    assert option(type="postgres", sslmode="require", port=1, batch_size=7) == {"url": "jdbc:postgresql://h:1/d?sslmode=require", "fetchsize": "7"}
    assert option(type="mysql")["url"] == "jdbc:mysql://h:3306/d"
    with pytest.raises(ValueError):
        option(type="sqlserver", schema="sales")


def test_describe_schema_and_default_keys(spark):
    found = sql.describe_schema(spark, views=catalogue._constraints(spark, SF)).where("constraint_type is not null").collect()
    assert [(r["table"], r.column, r.refers_to, r.delete_rule) for r in found] == [("customer", "c_custkey", None, None), ("orders", "o_custkey", "customer.c_custkey", "CASCADE")]
    spark.createDataFrame([(1, 2, 3)], "b int, a int, c int").createOrReplaceTempView("keyed")
    assert sql.default_keys(sql.list_columns(spark, "keyed", keys=("a", "b"))) == ["b", "a"]


def test_all_columns_and_unordered_types(spark):
    df = spark.createDataFrame([(1, "x", {"k": 1}), (1, "y", {"k": 2})], "K int, v string, tags map<string,int>")
    columns = combine.add_all_columns(df, "A", [{"name": "V", "ref": "A.v"}])
    assert [c["name"] for c in columns] == ["V", "K", "tags"]
    other = spark.createDataFrame([(1,)], "id int")
    joined = lookup_join(other, df, ["ID"], ["k"], "left")
    assert [r.v for r in project(joined, [{"name": "v", "ref": "B.v"}]).collect()] == ["y"]


def test_feed_failure_is_audited_and_made_again(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "id int, odd int")
    rules, seen, broken = [{"all": [{"field": "odd", "op": "eq", "value": 1}]}], [], [True]

    def job(hit, number):
        if number == 1 and broken[0]:
            raise RuntimeError("no luck")
        seen.append((number, sorted(r.id for r in hit.collect())))

    poll = lambda: feed.poll_table(lambda: df, "id", "int", rules, [(1, job)], str(tmp_path), batch=3, start="0")
    audit = lambda: {r.poll: (r.status, r.events, r.matched) for r in feed.read_audit(spark, f"{tmp_path}/audit").collect()}
    assert poll() == 3
    with pytest.raises(RuntimeError):
        poll()
    assert audit() == {0: ("completed", 3, 2), 1: ("failed", 3, 1)}
    broken[0] = False
    assert [poll(), poll(), poll()] == [3, 1, 0]
    assert seen == [(0, [1, 3]), (1, [5]), (2, [7])]
    assert audit() == {0: ("completed", 3, 2), 1: ("completed", 3, 1), 2: ("completed", 1, 1), 3: ("no_events", 0, 0)}
    assert [r.poll for r in feed.recent(feed.read_audit(spark, f"{tmp_path}/audit"), 2).collect()] == [3, 2]


def test_table_feed_polls_tick_by_tick(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    job = lambda hit, n: hit.write.mode("overwrite").parquet(f"{tmp_path}/out/poll={n}")
    query = feed.run_table_feed(
        spark, f"{tmp_path}/check", "1 second", read=lambda: df, column="id", kind="int", rules=[], jobs=[(1, job)], state_path=f"{tmp_path}/state", batch=2, start="0"
    )
    try:
        for _ in range(60):
            time.sleep(1)
            if query.exception() or (query.lastProgress and query.lastProgress["batchId"] >= 2 and not query.status["isTriggerActive"]):
                break
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").select("id").collect()) == [1, 2, 3, 4, 5]


def test_failed_stream_stops(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")

    def job(hit, number):
        raise RuntimeError("no luck")

    stream = feed.run_feed(feed.watch_folder(spark, f"{tmp_path}/in", spark.range(1).schema, 9), [], [(1, job)], f"{tmp_path}/audit", f"{tmp_path}/check")
    with pytest.raises(Exception, match="no luck"):
        stream.awaitTermination()
    row = feed.read_audit(spark, f"{tmp_path}/audit").first()
    assert (row.status, row.events, row.matched) == ("failed", 3, 3) and "no luck" in row.error and row.event_sample


def test_shared_frames_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)
    spark.createDataFrame([(1,), (2,)], "id int").createOrReplaceTempView("twice")

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    spec = catalogue._job("SELECT * FROM twice", [{"name": "id", "ref": "A.id"}], {"type": "db_output", "config": {"table": "t"}}, [{"id": "l", "type": "log", "config": {}}])
    spec["connexions"] += [{"from": "m", "to": "l", "type": "flow"}, {"from": "m", "to": "l", "type": "data"}]
    job = plan.build(spark, spec, given={"i": spark.table("twice").mapInArrow(count, "id int")}, persist=True)
    assert job.result("o").count() == 2 and job.result("l").count() == 2
    assert calls.value == 2 and len(job.persisted) == 1
    job.release()


def _node(kind, **config):
    return {"id": kind, "type": kind, "config": config}


@pytest.mark.parametrize(
    "nodes,links,words",
    [
        ([_node("start"), _node("start")], [], "repeat"), ([_node("log")], [], "start node"), ([_node("start")], [("start", "log", "flow")], "leads to no node"),
        ([_node("start"), _node("map")], [], "no output"), ([_node("start"), _node("db_output", table="a;b")], [], "not a table"),
        ([_node("start"), _node("map", outputs=[{}]), _node("log"), _node("db_input")], [("log", "map", "data"), ("db_input", "map", "data")], "no join"),
        ([_node("start"), _node("map", outputs=[{}], join={"type": "left"}), _node("log"), _node("db_input")], [("log", "map", "data"), ("db_input", "map", "data"), ("start", "map", "data")], "more than two"),
    ],
)
def test_spec_errors_by_kind(nodes, links, words):
    with pytest.raises(ValueError, match=words):
        plan.validate({"nodes": nodes, "connexions": [dict(zip(("from", "to", "type"), x)) for x in links]})


def test_core_stands_without_the_subpackage():
    """The entry works when a library of the subpackage, or the subpackage, is missing."""
    code = "import sys; sys.modules['{}'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q)"
    for missing in ("ahocorasick", "weftline.llm"):
        subprocess.run([sys.executable, "-c", code.format(missing)], check=True, cwd=Path(__file__).resolve().parents[1])
