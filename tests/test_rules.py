"""Rules as filters: what a scan is given to evaluate, and that it changes no row."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tests.plans import pushed_filters
from weftline import catalogue
from weftline.functions.rules import condition, rules_filter, strict

SF = "/root/testdata/sf0.001"
SCHEMA = "id int, i int, l long, d double, f float, m decimal(12,3), s string, b boolean, n struct<x:int,y:struct<z:string>>, t map<string,string>, j string"


def number(x):
    return 0.0 if x is None or isinstance(x, bool) else float(x)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from decimal import Decimal

    values = [None, -3, -1, 0, 1, 2, 50, 51, 1 << 40]
    rows = []
    for k, v in enumerate(values * 3):
        whole = v if v is None or abs(v) < 1 << 31 else 7
        real = None if v is None else [float(v), v + 0.5, v - 0.001][k // len(values)]
        rows.append((k, whole, v, real, None if real is None else float(v), None if real is None else Decimal(str(round(real, 3))) if abs(real) < 1e8 else Decimal("7.125"),
                     None if v is None else [str(v), f" {v}.5", "x"][k // len(values)], None, (whole, (None if v is None else str(v),)), {"k": str(v)} if v else {}, '{"k": %d}' % v if v else None))
    path = f"{tmp_path_factory.mktemp('rules')}/t"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def as_double(row, path):
    """The number that a field stands for, by the language's own coercions."""
    v = {"n.x": lambda: row.n.x, "n.y.z": lambda: row.n.y.z, "t.k": lambda: row.t.get("k"), "j.k": lambda: row.j and row.j[6:-1], "none": lambda: None}.get(path, lambda: row[path])()
    try:
        return number(v)
    except ValueError:
        return 0.0


@pytest.mark.parametrize("op", ["gt", "lt"])
def test_comparisons_equal_the_coercion_row_by_row(stored, op):
    rows = stored.collect()
    for path, x in itertools.product(["i", "l", "d", "f", "m", "s", "b", "n.x", "n.y.z", "t.k", "j.k", "none"], [-2, -1, -0.5, 0, 0.5, 1, 1.5, 50, "2", "abc", None, True, 1e300, -1e300, math.inf]):
        try:
            bound = 0.0 if x is None or isinstance(x, bool) else float(x)
        except ValueError:
            bound = 0.0
        want = sorted(r.id for r in rows if (as_double(r, path) > bound if op == "gt" else as_double(r, path) < bound))
        spec = {"field": path, "op": op, "value": x}
        got = sorted(r.id for r in rules_filter(stored, [{"all": [spec]}]).select("id").collect()) if x in (-1, 0.5, 1, 1e300) else None
        values = stored.select("id", strict(condition(stored.schema, spec)).alias("h")).collect() if got is None else []
        assert (got if got is not None else sorted(r.id for r in values if r.h)) == want, (path, op, x)


@pytest.mark.parametrize(
    "spec,bounds",
    [
        (("d", "gt", 10), ["GreaterThan(d,10.0)"]), (("d", "gt", -1), ["Or(GreaterThan(d,-1.0),IsNull(d))"]), (("d", "lt", -1), ["LessThan(d,-1.0)"]), (("d", "lt", 5), ["Or(LessThan(d,5.0),IsNull(d))"]),
        (("i", "gt", 10.5), ["GreaterThan(i,10)"]), (("l", "gt", 10.5), ["GreaterThan(l,10)"]), (("l", "lt", -10.5), ["LessThan(l,-10)"]), (("m", "gt", 2), ["GreaterThanOrEqual(m,"]),
        (("s", "gt", 3), ["IsNotNull(s)"]), (("j.k", "gt", 3), ["IsNotNull(j)"]), (("n.x", "gt", 3), ["GreaterThan(n.x,3)"]), (("n.y.z", "gt", 3), ["IsNotNull(n.y.z)"]),
        (("s", "startsWith", "a"), ["StringStartsWith(s,a)"]), (("s", "contains", "a"), ["StringContains(s,a)"]), (("l", "eq", 5.0), ["EqualNullSafe(l,5)"]), (("s", "neq", "a"), ["Not(EqualNullSafe(s,a))"]),
    ],
)
def test_conditions_reach_the_scan(stored, spec, bounds):
    pushed = pushed_filters(rules_filter(stored, [{"all": [dict(zip(("field", "op", "value"), spec))]}]))
    assert all(b in pushed for b in bounds), pushed


def test_registered_rules_reach_the_scan(spark):
    assert "GreaterThan(value,50.0)" in pushed_filters(catalogue.QUERIES["rule_gt"](spark, SF))
    both = pushed_filters(catalogue.QUERIES["rule_all_any"](spark, SF))
    assert "GreaterThan(value,10.0)" in both and "Or(EqualNullSafe(event_type,click),EqualNullSafe(event_type,view))" in both
    assert "IsNotNull(props)" in pushed_filters(catalogue.QUERIES["rule_nested_path"](spark, SF))


def test_variant_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "7"}, "c": [1]}'), (2, '{"a": {"b": null}}'), (3, "not json"), (4, None), (5, '{"a": 9}'), (6, '{"a": {"b": 2.5}}')], "id int, j string")
    df = df.withColumn("v", F.try_parse_json("j"))
    find = lambda name, *spec: sorted(r.id for r in rules_filter(df, [{"all": [dict(zip(("field", "op", "value"), (name + spec[0], *spec[1:])))]}]).collect())
    for spec in ((".a.b", "gt", 2), (".a.b", "lt", 5), (".a.b", "eq", 7), (".a.b", "eq", "7"), (".a.b", "exists", None), (".a.b", "notExists", None), (".a.b", "in", ["7", "2.5"]), (".x.y", "neq", 1), (".a.b", "startsWith", "2")):
        assert find("v", *spec) == find("j", *spec), spec
    assert find("v", ".a.b", "gt", 2) == [1, 6]
