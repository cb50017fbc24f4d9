"""Databases behind JDBC, here Derby: what their driver tells, parallel reads, writes by their own keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators.apply import apply
from weftline.sinks.writers import write_jdbc
from weftline.sources import metadata, sql

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
SHOP = """
CREATE SCHEMA SHOP;
CREATE TABLE SHOP.PLACE (COUNTRY CHAR(2) NOT NULL, CITY VARCHAR(40) NOT NULL, PEOPLE INT DEFAULT 0, CONSTRAINT PLACE_KEY PRIMARY KEY (CITY, COUNTRY));
CREATE TABLE SHOP.CUSTOMER (ID BIGINT NOT NULL PRIMARY KEY, MAIL VARCHAR(100) UNIQUE, TOWN VARCHAR(40), LAND CHAR(2), LIMIT_ DECIMAL(10,2), PHOTO BLOB, SINCE TIMESTAMP,
  CONSTRAINT LIVES FOREIGN KEY (TOWN, LAND) REFERENCES SHOP.PLACE (CITY, COUNTRY) ON DELETE SET NULL);
CREATE TABLE SHOP.ITEM (ORDER_ID INT NOT NULL, POSITION_ INT NOT NULL, BUYER BIGINT NOT NULL REFERENCES SHOP.CUSTOMER ON DELETE CASCADE, QTY DOUBLE, PRIMARY KEY (POSITION_, ORDER_ID));
CREATE TABLE SHOP.ITEMX (ORDER_ID INT);
CREATE TABLE SHOP."I_EM" ("a" INT NOT NULL PRIMARY KEY)
"""


@pytest.fixture
def shop(spark, tmp_path):
    link = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": DERBY}
    with metadata.jdbc_link(spark, link) as c:
        for text in SHOP.split(";"):
            s = c.createStatement()
            s.execute(text)
            s.close()
    return link


def test_schema_of_a_query_without_running_it(spark, shop):
    got = sql.infer_schema(spark, "SELECT ID, MAIL, LIMIT_, SINCE, PHOTO, ID FROM SHOP.CUSTOMER;", shop).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [
        (1, "ID", "BIGINT", "bigint", None, 19, None, False), (2, "MAIL", "VARCHAR", "string", 100, None, None, True), (3, "LIMIT_", "DECIMAL", "decimal(10,2)", None, 10, 2, True),
        (4, "SINCE", "TIMESTAMP", "timestamp", None, None, None, True), (5, "PHOTO", "BLOB", "binary", 2147483647, None, None, True), (6, "ID2", "BIGINT", "bigint", None, 19, None, False),
    ]
    spark.sql("SELECT CAST(1 AS DECIMAL(7,3)) AS d, 'x' AS s, 1 AS i").createOrReplaceTempView("kinds")
    assert [tuple(r) for r in sql.infer_schema(spark, "SELECT * FROM kinds").collect()] == [
        (1, "d", "decimal(7,3)", "decimal(7,3)", None, 7, 3, True), (2, "s", "string", "string", None, None, None, False), (3, "i", "int", "int", None, None, None, False),
    ]


def test_tables_and_columns(spark, shop):
    assert [tuple(r) for r in sql.list_tables(spark, shop).collect()] == [("SHOP", n) for n in ("CUSTOMER", "ITEM", "ITEMX", "I_EM", "PLACE")]
    got = sql.list_columns(spark, "shop.item", shop).orderBy("ordinal").collect()
    assert [(r.name, r.type, r.nullable, r.is_primary, r.key_position) for r in got] == [
        ("ORDER_ID", "int", False, True, 2), ("POSITION_", "int", False, True, 1), ("BUYER", "bigint", False, False, None), ("QTY", "double", True, False, None),
    ]
    assert [r.name for r in sql.list_columns(spark, "SHOP.I_EM", shop).collect()] == ["a"]  # its name is also a pattern for ITEM's
    place = {r.name: r for r in sql.list_columns(spark, "PLACE", shop | {"schema": "SHOP"}).collect()}
    assert place["PEOPLE"].default == "0" and place["CITY"].length == 40 and place["COUNTRY"].source_type == "CHAR"
    with pytest.raises(ValueError, match="no table"):
        sql.list_columns(spark, "SHOP.NONE", shop)
    assert sql.default_keys(sql.list_columns(spark, "SHOP.ITEM", shop)) == ["POSITION_", "ORDER_ID"] == metadata.primary_key(spark, "SHOP.ITEM", sql.jdbc_options(shop))


def test_composite_foreign_keys_pair_their_columns(spark, shop):
    got = sql.describe_schema(spark, shop).where("constraint_type = 'FOREIGN KEY'").collect()
    assert sorted((r.table, r.column, r.position, r.refers_to, r.update_rule, r.delete_rule) for r in got) == [
        ("CUSTOMER", "LAND", 2, "PLACE.COUNTRY", "NO ACTION", "SET NULL"), ("CUSTOMER", "TOWN", 1, "PLACE.CITY", "NO ACTION", "SET NULL"), ("ITEM", "BUYER", 1, "CUSTOMER.ID", "NO ACTION", "CASCADE"),
    ]
    every = sql.describe_schema(spark, shop).collect()
    assert {(r.table, r.column) for r in every if r.constraint_type == "UNIQUE"} == {("CUSTOMER", "MAIL")}
    assert {(r.table, r.column, r.position) for r in every if r.constraint_type == "PRIMARY KEY"} == {
        ("CUSTOMER", "ID", 1), ("PLACE", "CITY", 1), ("PLACE", "COUNTRY", 2), ("ITEM", "POSITION_", 1), ("ITEM", "ORDER_ID", 2), ("I_EM", "a", 1)
    }
    assert len(every) == 3 + 7 + 4 + 1 + 1  # a row for each column: none is in two keys


def information_schema(spark, same_names):
    """The views of a database with a foreign key of two columns; in MySQL every primary key is called PRIMARY."""
    name = (lambda t: "PRIMARY") if same_names else (lambda t: f"pk_{t}")
    column = lambda t, c, i: ("s", t, c, i, "int", "YES", None, None, None, None)
    views = {
        "columns": ([column("place", "country", 1), column("place", "city", 2), column("other", "id", 1), column("person", "town", 1), column("person", "land", 2)],
                    "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, character_maximum_length long, numeric_precision int, numeric_scale int, column_default string"),
        "key_column_usage": ([("s", "place", "city", name("place"), 1, None), ("s", "place", "country", name("place"), 2, None), ("s", "other", "id", name("other"), 1, None), ("s", "person", "town", "lives", 1, 1), ("s", "person", "land", "lives", 2, 2)],
                             "table_schema string, table_name string, column_name string, constraint_name string, ordinal_position int, position_in_unique_constraint int"),
        "table_constraints": ([("s", "place", name("place"), "PRIMARY KEY"), ("s", "other", name("other"), "PRIMARY KEY"), ("s", "person", "lives", "FOREIGN KEY")], "table_schema string, table_name string, constraint_name string, constraint_type string"),
        "referential_constraints": ([("s", "lives", "s", name("place"), "NO ACTION", "CASCADE", "person", "place")],
                                    "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string, update_rule string, delete_rule string, table_name string, referenced_table_name string"),
    }
    out = {k: spark.createDataFrame(*v) for k, v in views.items()}
    if not same_names:
        out["referential_constraints"] = out["referential_constraints"].drop("table_name", "referenced_table_name")
    return out


@pytest.mark.parametrize("same_names", [False, True])
def test_exported_information_schema(spark, same_names):
    comments = spark.createDataFrame([("s", "person", "town", "where they live")], "schema string, table string, column string, comment string")
    got = sql.describe_schema(spark, views=information_schema(spark, same_names), comments=comments).collect()
    assert sorted((r.table, r.column, r.constraint_type, r.refers_to, r.comment) for r in got) == [
        ("other", "id", "PRIMARY KEY", None, None), ("person", "land", "FOREIGN KEY", "place.country", None), ("person", "town", "FOREIGN KEY", "place.city", "where they live"),
        ("place", "city", "PRIMARY KEY", None, None), ("place", "country", "PRIMARY KEY", None, None),
    ]


def test_writes_find_the_keys_of_their_table(spark, shop):
    old = spark.createDataFrame([(1, 1, 7, 1.0), (1, 2, 7, 2.0), (2, 1, 7, 3.0)], "ORDER_ID int, POSITION_ int, BUYER long, QTY double")
    new = spark.createDataFrame([(1, 2, 7, 20.0), (3, 1, 7, 30.0)], old.schema)
    write_jdbc(spark.createDataFrame([(7, "m")], "ID long, MAIL string"), "SHOP.CUSTOMER", shop)
    write_jdbc(old, "SHOP.ITEM", shop)
    write_jdbc(new, "SHOP.ITEM", shop, "merge")
    read = lambda: sorted(map(tuple, sql.sql_source(spark, "SELECT * FROM SHOP.ITEM", shop).collect()))
    assert read() == sorted(map(tuple, apply(old, new, "merge", ["POSITION_", "ORDER_ID"]).collect()))
    write_jdbc(new, "ITEM", shop | {"schema": "SHOP"}, "delete")
    assert [r[:2] for r in read()] == [(1, 1), (2, 1)]


def test_skewed_column_is_read_in_even_parts(spark, tmp_path):
    link = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": DERBY}
    df = spark.range(8000).select(
        F.when(F.col("id") < 7600, F.col("id") % 4000).when(F.col("id") < 7990, F.col("id") * 1_000_000).alias("k"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.sqrt("id") * 1000).cast("decimal(18,6)"))).cast("timestamp").alias("at"), "id",
    )
    df.repartition(1).write.format("jdbc").options(**sql.jdbc_options(link)).option("dbtable", "t").save()
    for column, scan in (("k", None), ("k", 4), ("at", None)):
        got = sql.parallel_source(spark, "SELECT * FROM t;", link, column, 8, scan)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert got.rdd.getNumPartitions() == 8 and sum(sizes) == 8000 and max(sizes) <= 2 * 1000
        assert got.select("id").distinct().count() == 8000
    even = link | {"partitionColumn": '"k"', "lowerBound": 0, "upperBound": 8_000_000_000, "numPartitions": 8}
    sizes = [r["n"] for r in sql.sql_source(spark, "SELECT * FROM t", even).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) > 7000  # what even intervals give
    one = sql.parallel_source(spark, 'SELECT 5 AS "c" FROM t', link, "c", 8)
    assert one.count() == 8000 and one.rdd.getNumPartitions() <= 2
    none = sql.parallel_source(spark, 'SELECT * FROM t WHERE "id" < 0', link, "k", 8)
    assert none.count() == 0


def test_predicates_by_dialect():
    at = [dt.datetime(2024, 1, 1, 0, 0, 0, 5), dt.datetime(2024, 2, 1)]
    assert sql.split_predicates([3, 9], "k", {"type": "mysql"}) == ["`k` <= 3 OR `k` IS NULL", "`k` > 3 AND `k` <= 9", "`k` > 9"]
    assert sql.split_predicates(at[:1], "at", {"type": "sqlserver"})[1] == "[at] > CAST('2024-01-01 00:00:00.000005' AS DATETIME2)"
    assert sql.split_predicates([dt.date(2024, 1, 2)], "d", {"type": "postgres"}) == ["\"d\" <= CAST('2024-01-02' AS DATE) OR \"d\" IS NULL", "\"d\" > CAST('2024-01-02' AS DATE)"]
