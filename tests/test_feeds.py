"""Feeds over growing tables: nothing is lost or repeated, whatever arrives or dies meanwhile."""

import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.plans import pushed_filters
from weftline.sources import metadata, sql
from weftline.sources.cursor import Cursor
from weftline.streaming import feed

ROOT = Path(__file__).resolve().parents[1]
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def statements(spark, link, *texts):
    with metadata.jdbc_link(spark, link) as c:
        for text in texts:
            s = c.createStatement()
            s.execute(text)
            s.close()


def audit(spark, path):
    return [(r.poll, r.status, r.events) for r in feed.read_audit(spark, f"{path}/audit").orderBy("poll", "at").collect()]


@pytest.mark.parametrize("streamed", [False, True])
def test_rows_inserted_while_a_job_runs_come_with_the_next_poll(spark, tmp_path, streamed):
    link = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": DERBY}
    statements(spark, link, 'CREATE TABLE "t" ("id" INT, "v" VARCHAR(9))', *[f"INSERT INTO \"t\" VALUES ({i}, 'v{i}')" for i in range(1, 11)])
    got, left = [], [range(11, 16), range(16, 18)]

    def job(hit, number):
        if left:
            statements(spark, link, *[f"INSERT INTO \"t\" VALUES ({i}, 'late')" for i in left.pop(0)])
        got.append((number, sorted(r.id for r in hit.collect())))

    read = lambda: sql.sql_source(spark, 'SELECT * FROM "t"', link)
    poll = {"column": "id", "kind": "int", "rules": [], "jobs": [(1, job)], "state_path": str(tmp_path), "batch": 10}
    if streamed:
        feed.run_table_feed(spark, f"{tmp_path}/check", read=read, available_now=True, **poll)
    else:
        while feed.poll_table(read, **poll):
            pass
    assert got == [(0, list(range(1, 11))), (1, [*range(11, 18)])] or got == [(0, list(range(1, 11))), (1, [*range(11, 16)]), (2, [16, 17])]
    assert audit(spark, tmp_path)[-1][1] == "no_events"


def test_bounds_inside_the_database(spark, tmp_path):
    """The database's own ordered read finds the watermark that Spark finds."""
    link = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": DERBY, "type": "derby"}
    df = spark.createDataFrame([(i // 7, i, f"2024-01-01 00:00:{i % 60:02d}.5") for i in range(100)], "g int, id int, s string").selectExpr("g", "id", "cast(s as timestamp_ntz) ts")
    df.write.format("jdbc").options(**sql.jdbc_options(link)).option("dbtable", "t").save()
    for cursor, where in ((Cursor("g", "int", "id"), None), (Cursor("id"), '"g" < 9'), (Cursor("ts", "timestamp", "id"), None)):
        mark, seen = None, []
        for _ in range(20):
            here = cursor.bound(df, mark, 9, where.replace('"', "") if where else None)
            assert cursor.bound_jdbc(spark, "t", link, mark, 9, where) is None if here is None else True
            if here is None:
                break
            there = cursor.bound_jdbc(spark, "t", link, mark, 9, where)
            rows = {r.id for r in cursor.slice(df, mark, here).where(where.replace('"', "") if where else "true").collect()}
            assert rows == {r.id for r in cursor.slice(df, mark, there).where(where.replace('"', "") if where else "true").collect()}
            seen += sorted(rows)
            mark = there
        want = df.where("id > 0" if cursor.column == "id" else "g > 0" if cursor.column == "g" else "true")
        assert sorted(seen) == sorted(r.id for r in want.where(where.replace('"', "") if where else "true").collect())


def test_dialects_of_bounds():
    cursor = Cursor("at", "timestamp", "id")
    mark = '["2024-01-01 00:00:00", "7"]'
    assert cursor.bound_query("s.t", "postgres", mark, 99) == (
        "SELECT \"at\", \"id\" FROM s.t WHERE \"at\" >= CAST('2024-01-01 00:00:00' AS TIMESTAMP) AND (\"at\" > CAST('2024-01-01 00:00:00' AS TIMESTAMP) OR \"id\" > 7) "
        'ORDER BY "at", "id" OFFSET 99 ROWS FETCH NEXT 1 ROWS ONLY'
    )
    assert cursor.bound_query("t", "mysql", None, 0, "x = 1", last=True) == (
        "SELECT `at`, `id` FROM t WHERE `at` > CAST('0001-01-01 00:00:00' AS DATETIME(6)) AND (x = 1) ORDER BY `at` DESC, `id` DESC LIMIT 1 OFFSET 0"
    )
    assert "[at] > CAST('it''s'" in Cursor("at", "timestamp").bound_query("t", "sqlserver", "it's", 0)
    with pytest.raises(ValueError):
        Cursor("at; drop")
    with pytest.raises(ValueError):
        Cursor("at", "float")


def test_one_value_in_a_thousand_rows_is_polled_whole(spark):
    df = spark.createDataFrame([(7, i) for i in range(1000)] + [(9, 5), (None, 1)], "w int, id int").repartition(4)
    cursor, mark, polls = Cursor("w", "int", "id"), None, []
    while (upto := cursor.bound(df, mark, 100)) is not None:
        polls.append({(r.w, r.id) for r in cursor.slice(df, mark, upto).collect()})
        assert polls[-1] == {(r.w, r.id) for r in cursor.poll(df, mark, 100).collect()}
        mark = upto
    assert [len(p) for p in polls] == [100] * 10 + [1] and len(set().union(*polls)) == 1001
    assert mark == '["9", "5"]' and cursor.decode("9") == ("9", None)


def test_comparisons_of_a_cursor_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id div 10 as w", "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    pushed = pushed_filters(Cursor("w", "int", "id").slice(df, '["3", "35"]', '["7", "71"]'))
    for part in ("GreaterThanOrEqual(w,3)", "LessThanOrEqual(w,7)", "Or(GreaterThan(w,3),GreaterThan(id,35))"):
        assert part in pushed


def test_failed_stream_goes_on_where_it_failed(spark, tmp_path):
    df = spark.range(1, 26).toDF("id")
    broken, seen = [True], {}

    def job(hit, number):
        if number == 2 and broken[0]:
            raise RuntimeError("no luck")
        seen.setdefault(number, []).append(sorted(r.id for r in hit.collect()))

    run = lambda: feed.run_table_feed(
        spark, f"{tmp_path}/check", read=lambda: df, column="id", kind="int", rules=[], jobs=[(1, job)], state_path=str(tmp_path), batch=7, available_now=True
    )
    with pytest.raises(Exception, match="no luck"):
        run()
    assert audit(spark, tmp_path)[-1] == (2, "failed", 7)
    broken[0] = False
    run()
    run()  # nothing is new
    assert seen == {0: [list(range(1, 8))], 1: [list(range(8, 15))], 2: [list(range(15, 22))], 3: [list(range(22, 26))]}
    assert [a for a in audit(spark, tmp_path) if a[1] == "completed"] == [(0, "completed", 7), (1, "completed", 7), (2, "completed", 7), (3, "completed", 4)]
    assert len([a for a in audit(spark, tmp_path) if a[1] == "no_events"]) >= 2


KILLED = """
    import os, sys
    from pyspark.sql import SparkSession
    from weftline.streaming import feed
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    folder, die = sys.argv[1], sys.argv[2] == "die"

    def job(hit, number):
        hit.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        if die and number == 1:
            os._exit(9)

    feed.run_table_feed(spark, f"{folder}/check", read=lambda: spark.read.parquet(f"{folder}/t"), column="id", kind="int", rules=[], jobs=[(1, job)],
                        state_path=folder, batch=10, available_now=True)
"""


def test_killed_run_goes_on_without_loss_or_repeat(spark, tmp_path):
    spark.range(1, 41).toDF("id").write.parquet(f"{tmp_path}/t")
    code = [sys.executable, "-c", textwrap.dedent(KILLED), str(tmp_path)]
    assert subprocess.run([*code, "die"], cwd=ROOT, capture_output=True, timeout=300).returncode == 9
    spark.range(41, 46).toDF("id").write.mode("append").parquet(f"{tmp_path}/t")
    done = subprocess.run([*code, "live"], cwd=ROOT, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = spark.read.parquet(f"{tmp_path}/out/*").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.id, r.n) for r in rows) == [(i, 1) for i in range(1, 46)]


def test_running_feed_sees_new_rows_and_stops(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1, 4).toDF("id").write.parquet(path)
    seen = []
    query = feed.run_table_feed(
        spark, f"{tmp_path}/check", "1 second", read=lambda: spark.read.parquet(path), column="id", kind="int", rules=[],
        jobs=[(1, lambda hit, n: seen.extend(r.id for r in hit.collect()))], state_path=str(tmp_path), batch=10,
    )
    try:
        for add in (4, 5):
            for _ in range(60):
                if len(seen) >= add - 1:
                    break
                time.sleep(0.5)
            spark.range(add, add + 1).toDF("id").write.mode("append").parquet(path)
        for _ in range(60):
            if len(seen) >= 5:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(seen) == [1, 2, 3, 4, 5]
