from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from keelson.model import TableSpec, chosen_tables, coerced, spec_of
from keelson.operators.apply import apply_diff, insert_ignore, quarantine, repair, replace, retry, retry_differing, write_isolating
from keelson.operators.checksum import checksums
from keelson.operators.diff import diff, diff_via_checksum, diff_within

ONE, TWO = TableSpec("t", ("id",), chunk_size=2), TableSpec("t", ("a", "b"), chunk_size=2)
CASES = [
    ("", "", []),
    ("1:A", "1:A", []),
    ("1:A", "", ["insert 1:A"]),
    ("", "1:A", ["delete 1:A"]),
    ("1:B", "1:A", ["update 1:B"]),
    ("1:A 2:B", "1:A", ["insert 2:B"]),
    ("1:A", "1:A 2:B", ["delete 2:B"]),
    ("1:A 2:B", "1:A 2:A", ["update 2:B"]),
    ("1:A 2:B 3:C", "1:A 3:C", ["insert 2:B"]),
    ("1:A 2:B 3:C 4:D", "1:A 4:D", ["insert 2:B", "insert 3:C"]),
    ("1:A 4:D", "1:A 2:B 3:C 4:D", ["delete 2:B", "delete 3:C"]),
]


def _rows(spark, text):
    return spark.createDataFrame([(int(x.split(":")[0]), x.split(":")[1]) for x in text.split()], "id long, v string")


def _said(found):
    return sorted(f"{r['type']} {r['row']['id']}:{r['row']['v']}" for r in found.collect())


@pytest.mark.parametrize("source,target,wanted", CASES)
def test_cases(spark, source, target, wanted):
    s, t = _rows(spark, source), _rows(spark, target)
    found = diff(s, t, ONE)
    assert _said(found) == wanted
    assert _said(diff_via_checksum(s, t, ONE)) == wanted
    assert diff(s, apply_diff(t, found, ["id"]), ONE).isEmpty()


def test_composite_keys(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "a long, b long, v string")
    got = diff(rows((1, 4, "A"), (2, 3, "B"), (3, 2, "C"), (4, 1, "D")), rows((1, 4, "A"), (4, 1, "D")), TWO)
    assert sorted((r["type"], r["a"], r["b"]) for r in got.collect()) == [("insert", 2, 3), ("insert", 3, 2)]
    assert [r["type"] for r in diff(rows((1, 1, "A")), rows((1, 1, "A"), (2, 1, "B")), TWO).collect()] == ["delete"]


def test_nulls_nan_and_types(spark):
    s = spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0)], "id long, v string, d double")
    assert diff(s, s, ONE).isEmpty()
    t = spark.createDataFrame([(1, "y", float("nan")), (2, None, 1.0)], "id long, v string, d double")
    assert diff(s, t, ONE).count() == 2
    # the bytes of a number equal the number
    b = s.selectExpr("cast(cast(id as string) as binary) as id", "v", "d")
    assert diff(s, b, ONE).isEmpty()
    with pytest.raises(ValueError):
        diff(s, t.drop("v"), ONE)
    with pytest.raises(ValueError):
        diff(s.drop("id"), t, ONE)


@pytest.mark.parametrize("mode", ["rows", "crc32"])
@pytest.mark.parametrize(
    "kinds,same,differ",
    [
        ("int double", [(1, 1.0), (None, None)], [(1, 1.7), (None, 1.0), (1, float("nan"))]),
        ("long double", [(1 << 53, float(1 << 53))], [((1 << 53) + 1, float(1 << 53))]),
        ("int long", [(7, 7)], [(None, 1 << 40), (0, 1 << 32)]),
        ("int string", [(1, "1"), (1, "1.0"), (None, None)], [(None, "abc"), (1, "1.7"), (1, ""), (1, None)]),
        ("string int", [("1", 1)], [("abc", None), ("abc", 1), (None, 1)]),
        ("double string", [(0.1, "0.1"), (float("nan"), "NaN")], [(0.1, "0.10000001"), (0.1, "x")]),
        ("boolean int", [(True, 1), (False, 0)], [(True, 2), (True, 0), (None, 0)]),
        ("decimal(10,2) double", [(Decimal("1.10"), 1.1)], [(Decimal("1.10"), 1.101)]),
        ("string binary", [("a", bytearray(b"a"))], [("a", bytearray(b"b")), (None, bytearray(b""))]),
        ("int binary", [(30, bytearray(b"30"))], [(30, bytearray(b"30x"))]),
        ("string timestamp", [("2024-01-01 00:00:00", datetime(2024, 1, 1))], [("2024-01-01 00:00:00", datetime(2024, 1, 1, 0, 0, 0, 500_000)), ("then", datetime(2024, 1, 1))]),
    ],
)
def test_what_reading_a_cell_would_lose_is_a_difference(spark, kinds, same, differ, mode):
    a, b = kinds.split()
    for cells, wanted in ((same, 0), (differ, len(differ))):
        s, t = (spark.createDataFrame([(i, x[side]) for i, x in enumerate(cells)], f"id long, v {kind}") for side, kind in ((0, a), (1, b)))
        assert diff(s, t, ONE).where("type = 'update'").count() == diff(s, t, ONE).count() == wanted
        assert diff_via_checksum(s, t, ONE, mode).count() == wanted


def test_null_keys_and_keys_of_another_type(spark):
    s = spark.createDataFrame([(None, "A"), (1, "B")], "id long, v string")
    assert diff(s, s, ONE).isEmpty() and diff_via_checksum(s, s, ONE).isEmpty() and diff_via_checksum(s, s, ONE, "crc32").isEmpty()
    t = spark.createDataFrame([(None, "X"), (1, "B")], "id long, v string")
    for found in (diff(s, t, ONE), diff_via_checksum(s, t, ONE), diff_within(s, t, ONE, s)):
        assert [(r["type"], r["id"], r["target"]["v"]) for r in found.collect()] == [("update", None, "X")]
    with pytest.raises(Exception, match="key of the target"):
        diff(s, spark.createDataFrame([("x", "B")], "id string, v string"), ONE).collect()
    fixed, left = repair(s, t, ONE)
    assert left.isEmpty() and sorted(fixed.collect(), key=str) == sorted(s.collect(), key=str)


def test_coerced(spark):
    raw = spark.createDataFrame([(bytearray(b"30027935561"), "abc")], "a binary, b string")
    got = coerced(raw, spark.createDataFrame([], "a long, b long").schema).first()
    assert got["a"] == 30027935561 and got["b"] is None
    wide = spark.sql("select cast(18446744073709551615 as decimal(20,0)) as x")
    assert wide.where("x > 9223372036854775807").count() == 1


def test_crc_gate_misses_a_swap_that_rows_see(spark):
    s, t = _rows(spark, "1:A 2:B"), _rows(spark, "1:B 2:A")
    assert diff_via_checksum(s, t, ONE, "crc32").isEmpty()
    assert diff_via_checksum(s, t, ONE).count() == 2


def test_row_checksums_see_where_a_null_is(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "chunk_id long, x string, y string")
    assert checksums(rows, ["x", "y"]).select("checksum").distinct().count() == 2


def test_spec_validation(spark):
    TableSpec("t", ("id",)).validate(_rows(spark, "1:A 2:B"), unique=True)
    for rows in (_rows(spark, "1:A 1:B"), spark.createDataFrame([(None, "a")], "id long, v string")):
        with pytest.raises(ValueError):
            TableSpec("t", ("id",)).validate(rows, unique=True)
    with pytest.raises(ValueError):
        TableSpec("t", ()).validate(_rows(spark, "1:A"))


def test_writes(spark):
    t = _rows(spark, "1:A 2:B")
    said = lambda df: sorted(f"{r['id']}:{r['v']}" for r in df.collect())
    assert said(insert_ignore(t, _rows(spark, "2:X 3:C"), ["id"])) == ["1:A", "2:B", "3:C"]
    assert said(replace(t, _rows(spark, "2:X 3:C"), ["id"])) == ["1:A", "2:X", "3:C"]
    assert said(replace(t, _rows(spark, "2:X 3:C").select("id"), ["id"])) == ["1:A", "2:B", "3:None"]
    assert said(insert_ignore(t, _rows(spark, "3:C 3:D 3:E"), ["id"]))[:2] == ["1:A", "2:B"] and insert_ignore(t, _rows(spark, "3:C 3:D 3:E"), ["id"]).count() == 3
    assert said(insert_ignore(t, _rows(spark, "3:C").select("id"), ["id"])) == ["1:A", "2:B", "3:None"]
    good, bad = quarantine(t, {"short": t["v"] == "A"})
    assert said(good) == ["1:A"] and bad.first()["broken"] == ["short"]


def test_bad_rows_are_isolated_and_the_others_written(spark):
    wrote = []

    def write(df):
        rows = df.collect()
        if any(r["v"] == "bad" for r in rows):
            raise ValueError("constraint")
        wrote.extend(r["id"] for r in rows)

    rows = spark.createDataFrame([(i, "bad" if i in (3, 11) else "ok") for i in range(16)], "id long, v string")
    assert sorted(r["id"] for r in write_isolating(rows, write, ["id"]).collect()) == [3, 11]
    assert sorted(wrote) == [i for i in range(16) if i not in (3, 11)]
    assert write_isolating(rows.where("false"), write, ["id"]).isEmpty()


def test_retries_wait_longer_each_time():
    waits, left = [], [ValueError(), ValueError(), ValueError()]

    def action():
        if left:
            raise left.pop()
        return "done"

    assert retry(action, least_seconds=1, most_seconds=3, sleep=waits.append) == "done" and waits == [1, 2, 3]
    left[:] = [KeyError()]
    with pytest.raises(KeyError):
        retry(action, permanent=(KeyError,), sleep=waits.append)
    left[:] = [ValueError()] * 3
    with pytest.raises(ValueError):
        retry(action, attempts=2, sleep=waits.append)


def test_repair_until_nothing_differs(spark):
    s, t = _rows(spark, "1:A 2:B 3:C"), _rows(spark, "1:A 2:X 4:D")
    fixed, left = repair(s, t, ONE)
    assert left.isEmpty() and sorted(fixed.collect()) == sorted(s.collect())
    _, left = repair(s, t, ONE, write=lambda df: t, attempts=2)
    assert left.count() == 3


def test_only_lasting_differences_count(spark):
    s = _rows(spark, "1:A 2:B")
    reads = iter([(s, _rows(spark, "1:A")), (s, s)])
    assert retry_differing(lambda: next(reads), ONE, retries=1).isEmpty()
    assert diff_within(s, _rows(spark, "2:C"), ONE, _rows(spark, "1:A")).count() == 1


def test_tables_and_config():
    assert chosen_tables(["a", "b", "_keelson_x"], ignored=["b"]) == ["a"]
    assert chosen_tables(["a", "b"], {"b": {}}) == ["b"] and chosen_tables(["a", "b"], allowed=["a"]) == ["a"]
    spec = spec_of({"keys": ["x"], "chunk_size": 7, "source_where": "y > 1", "write_timeout": "3s"}, "t", ["id"])
    assert spec.keys == ("x",) and spec.chunk_size == 7 and spec.source_where == "y > 1"
