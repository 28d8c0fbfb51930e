from __future__ import annotations

from itertools import product

import pytest

from keelson.operators.predicates import compare, in_range, overlaps
from keelson.sources.jdbc import Database, Target, chunk_predicate


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "="])
@pytest.mark.parametrize("arity", [1, 2, 3])
def test_compares_as_tuples_do(spark, op, arity):
    keys, bound = [f"k{i}" for i in range(arity)], (1,) * arity
    rows = list(product(range(3), repeat=arity))
    got = spark.createDataFrame(rows, [f"{k}" for k in keys]).select(*keys, compare(keys, op, bound).alias("ok")).collect()
    wanted = {"<": lambda r: r < bound, "<=": lambda r: r <= bound, ">": lambda r: r > bound, ">=": lambda r: r >= bound, "=": lambda r: r == bound}[op]
    assert all(r["ok"] == wanted(tuple(r)[:arity]) for r in got)


def test_composite_range_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a")], "a long, b long, c string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(in_range(["a", "b"], (1, 1), (5, 1)))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThan(a,1),And(EqualTo(a,1),GreaterThanOrEqual(b,1)))" in plan.replace(", ", ",").replace("PushedFilters:[", "PushedFilters: [")


def test_unbounded_and_overlapping_ranges(spark):
    rows = spark.createDataFrame([(1, 9), (9, 1), (9, 9), (None, 1)], "b long, a long")
    assert rows.where(in_range(["b"], None, None)).count() == 4
    assert rows.where(overlaps(["b"], ["a"], (0,), (5,))).count() == 3


def test_predicate_text_and_targets():
    assert chunk_predicate(["a", "b"], (1, 2), (3, "x'y"), "c > 0") == "(c > 0) AND (`a` > 1 OR (`a` = 1 AND `b` >= 2)) AND (`a` < 3 OR (`a` = 3 AND `b` < 'x''y'))"
    assert chunk_predicate(["a"], None, None) == "1 = 1"
    assert Target.parse("customer/-80@replica") == Target("customer", "-80", "replica")
    assert Target.parse("customer:80-").sharded and not Target.parse("customer").sharded and not Target.parse("main/0").sharded
    assert str(Target.parse("ks/-80@RDONLY")) == "ks/-80@rdonly"
    assert ":4000/" in Database("h", kind="tidb", database="d").options()["url"]
    assert "sessionInitStatement" in Database("h", kind="vitess", streaming=True).options()
