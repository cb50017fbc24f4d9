"""Partition-wise changes, stored lookup sides and message templates."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tests.plans import formatted
from weftline.functions.templates import compiled
from weftline.operators.apply import apply
from weftline.operators.combine import lookup_join, project
from weftline.operators.dimension import StoredDimension
from weftline.sinks.partitions import PartitionedTable
from weftline.sinks.writers import all_messages


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def fifty(spark, tmp_path):
    target = PartitionedTable(spark, f"{tmp_path}/t", ["p"])
    rows = spark.range(1000).selectExpr("id", "cast(id % 50 as int) as p", "concat('v', id) as v")
    target.apply(rows, "insert")
    return target, rows, f"{tmp_path}/t"


def same(table, frame):
    columns = sorted(frame.columns)
    assert sorted(map(tuple, table.read().select(*columns).collect()), key=str) == sorted(map(tuple, frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("mode", ["merge", "update", "delete"])
@pytest.mark.parametrize("keys", [["id"], ["id", "p"]])
def test_a_change_leaves_other_partitions_as_they_are(spark, fifty, mode, keys):
    target, rows, path = fifty
    before = files(path)
    change = spark.createDataFrame([(7, 7, "new"), (57, 7, "new"), (2007, 7, "added")], "id long, p int, v string")
    assert target.apply(change, mode, keys) == 1
    after = files(path)
    assert {f for f in before if "p=7/" not in f} == {f for f in after if "p=7/" not in f}
    assert all(before[f] == after[f] for f in before if f in after) and any("p=7/" in f and f not in before for f in after)
    same(target, apply(rows, change, mode, keys, ["id", "p", "v"]))


def test_rows_that_move_and_partitions_that_empty(spark, fifty):
    target, rows, path = fifty
    change = spark.createDataFrame([(i, 60, "moved") for i in range(3, 1000, 50)], "id long, p int, v string")
    assert target.apply(change, "merge", ["id"]) == 2
    assert not any("p=3/" in f for f in files(path)) and any("p=60/" in f for f in files(path))
    want = apply(rows, change, "merge", ["id"])
    same(target, want)
    none = spark.createDataFrame([(60,)], "p int")
    assert target.apply(none, "delete", ["p"]) == 1 and target.apply(none, "delete", ["p"]) == 1
    same(target, apply(want, none, "delete", ["p"]))
    assert target.apply(spark.createDataFrame([(-1,)], "id long"), "delete", ["id"]) == 0
    target.apply(rows, "truncate")
    assert target.read().count() == 0


def test_partitions_of_text_null_and_two_columns(spark, tmp_path):
    target = PartitionedTable(spark, f"{tmp_path}/t", ["a", "b"], schema=spark.createDataFrame([], "id int, v string, a string, b int").schema)
    rows = spark.createDataFrame([(1, "x", "one / two", 1), (2, "x", None, 2), (3, "x", "é=%", None), (4, "x", "4", 1)], "id int, v string, a string, b int")
    target.apply(rows, "insert")
    change = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y")], "id int, v string")
    assert target.apply(change, "update", ["id"]) == 3
    rows = apply(rows, change, "update", ["id"])
    same(target, rows)
    target.apply(change, "delete", ["id"])
    same(target, rows.where("id = 4"))
    plain = PartitionedTable(spark, f"{tmp_path}/plain")
    plain.apply(rows, "merge", ["id"])
    plain.apply(change, "delete", ["id"])
    same(plain, rows.where("id = 4"))


def test_stored_dimension_is_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = spark.createDataFrame([(i % 40 if i % 9 else None, i, f"v{i}") for i in range(400)], "k int, seq int, v string")
        events = spark.createDataFrame([(i, i % 60 if i % 7 else None) for i in range(300)], "id int, k int")
        kept = StoredDimension(spark, "dimension_of_test", ["k"], 4)
        kept.save(side, ["seq"], f"{tmp_path}/d")
        columns = [{"name": "id", "ref": "A.id"}, {"name": "v", "ref": "B.v"}]
        for kind in ("inner", "left"):
            plan = formatted(project(kept.lookup(events, ["k"], kind), columns))
            assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1 and "SelectedBucketsCount: 4 out of 4" in plan
            got = project(kept.lookup(events, ["k"], kind), columns)
            want = project(lookup_join(events, side, ["k"], ["k"], kind, order_by=["seq"]), columns)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        text = events.withColumn("k", F.col("k").cast("string"))
        assert kept.lookup(text, ["k"], "inner").count() == kept.lookup(events, ["k"], "inner").count()
        real = events.withColumn("k", F.col("k") + F.lit(0.5))
        assert kept.lookup(real, ["k"], "inner").count() == len([i for i in range(300) if i % 7 == 0])  # NULL keys only
        with pytest.raises(ValueError):
            kept.lookup(events, ["k"], "full")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS dimension_of_test")


ORDER = "id int, first_name string, amount double, paid boolean, place struct<city:string,land:struct<code:string>>, items array<struct<name:string,n:int,at:struct<x:int>>>, tags map<string,string>"
ORDERS = [
    (1, "Ann", 10.0, True, ("Bonn", ("DE",)), [("cup", 2, (1,)), ("pot", 1, (2,))], {"a": "x"}),
    (2, "Bob", 0.0, False, None, [], None),
    (3, None, None, None, (None, None), [("cup", 0, None)], {}),
]


@pytest.mark.parametrize(
    "template,want",
    [
        ("Hi {{.FirstName}}!", ["Hi Ann!", "Hi Bob!", "Hi !"]),
        ("{{ .place.city }}", ["Bonn", None, ""]),
        ("{{.Place.Land.Code}}", ["DE", None, None]),
        ("{{if .paid}}yes{{else}}no{{end}}", ["yes", "no", "no"]),
        ("{{if .amount}}{{.amount}}{{else if .first_name}}free{{else}}?{{end}}", ["10.0", "free", "?"]),
        ("{{range .items}}[{{.name}} x{{.n}}]{{else}}nothing{{end}}", ["[cup x2][pot x1]", "nothing", "[cup x0]"]),
        ("{{range .items}}{{$.id}}{{if gt .n 1}}*{{end}}{{end}}", ["1*1", "", "3"]),
        ("{{range .items}}{{.at.x}}{{end}}", ["12", "", None]),
        ("{{if .place}}{{.place.city}}{{end}}", ["Bonn", "", ""]),
        ("{{with .place}}{{.city}}-{{$.id}}{{else}}none{{end}}", ["Bonn-1", "none", "-3"]),
        ('{{if eq .first_name "Ann" "Eve"}}A{{end}}{{if ne .id 2}}N{{end}}', ["AN", "", "N"]),
        ('{{if and .paid (gt .amount 5)}}big{{end}}{{if not .items}}empty{{end}}{{if or (eq .id 2) (eq .id 3)}}late{{end}}', ["big", "emptylate", "late"]),
        ("a  {{- .id -}}  b {{/* no */}}c", ["a1b c", "a2b c", "a3b c"]),
        ("{{len .items}}{{upper .first_name}}{{.tags.a}}", ["2ANNx", "0BOB", "1"]),
        ("no actions", ["no actions"] * 3),
    ],
)
def test_templates(spark, template, want):
    df = spark.createDataFrame(ORDERS, ORDER)
    text, error = compiled(template, df.schema)
    got = [(r.t, r.e) for r in df.select("id", text.alias("t"), error.alias("e")).orderBy("id").collect()]
    assert [None if e else t for t, e in got] == want


@pytest.mark.parametrize("template", ["{{if .id}}", "{{end}}", "{{else}}", "{{.none}}", "{{.place.none}}", "{{range .id}}{{end}}", "{{eq .id}}", "{{frob .id}}", "{{.id .id}}", "{{.first_name.x}}", "{{(eq .id 1}}"])
def test_bad_templates(spark, template):
    with pytest.raises(ValueError):
        compiled(template, spark.createDataFrame(ORDERS, ORDER).schema)


def test_rows_whose_template_fails_are_a_second_output(spark):
    df = spark.createDataFrame(ORDERS, ORDER)
    sent, rejected = all_messages(df, "Order {{.id}}", "to {{.place.city}}", ["a@b", "c@d"], html=True)
    assert [(r["to"], r.subject, r.body, r.content_type) for r in sent.orderBy("subject").collect()] == [("a@b,c@d", "Order 1", "to Bonn", "text/html"), ("a@b,c@d", "Order 3", "to ", "text/html")]
    assert [(r.error, '"id":2' in r.row) for r in rejected.collect()] == [(".place.city: its parent is NULL", True)]
