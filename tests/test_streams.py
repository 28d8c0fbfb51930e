from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.plans import logs
from keelson.streaming.apply import _Chunk

COLUMNS = ["chunk_id", "at", "part", "kind", "key", "live", "row"]


class _State:
    """A processor's state in memory, which counts how often it is asked."""

    def __init__(self):
        self.map, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        state, one = self, _One()
        one.state = state
        return one

    def containsKey(self, k):
        self.calls += 1
        return k in self.map

    def getValue(self, k):
        self.calls += 1
        return self.map[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.map[k] = v

    def iterator(self):
        self.calls += 1
        return iter(list(self.map.items()))

    def clear(self):
        self.calls += 1
        self.map.clear()


class _One:
    def exists(self):
        self.state.calls += 1
        return self.state.value is not None

    def update(self, v):
        self.state.calls += 1
        self.state.value = v

    def clear(self):
        self.state.calls += 1
        self.state.value = None


def _run(batches):
    chunk, state, out = _Chunk(), _State(), []
    chunk.init(state)
    for rows in batches:
        frames = [pd.DataFrame(rows[i : i + 3], columns=COLUMNS) for i in range(0, len(rows), 3)]
        out.append(sorted(tuple(r) for f in chunk.handleInputRows((7,), iter(frames), None) for r in f.itertuples(index=False)))
    return out, state


def _one_by_one(batches):
    """The rule, row by row."""
    rows, is_open, out = {}, False, []
    for batch in batches:
        said = []
        for _, at, part, kind, k, live, row in sorted(batch, key=lambda r: (r[1], r[2])):
            if kind == "low":
                is_open = True
            elif is_open and kind == "high":
                said += [(7, x, v[3]) for x, v in rows.items() if v[2]]
                rows, is_open = {}, False
            elif is_open and kind != "high":
                new = (-1, 0, live, row) if kind == "read" else (at, part, live, row)
                if k not in rows or rows[k][:2] < new[:2]:
                    rows[k] = new
        out.append(sorted(said))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_chunks_follow_the_rule_over_micro_batches(seed):
    dice, n = random.Random(seed), 0
    batches = []
    for _ in range(dice.randint(1, 5)):
        batch = []
        for _ in range(dice.randint(1, 25)):
            kind, n = dice.choices(["low", "high", "read", "change"], [2, 1, 3, 8])[0], n + 1
            at = dice.randint(0, 12)
            mark = kind in ("low", "high")
            batch.append((7, at, 1 << 40 if mark else dice.randint(0, 1), kind, None if mark else dice.choice("abcd"), None if mark else dice.random() < 0.7, None if mark else str(n)))
        batches.append(batch)
    out, state = _run(batches)
    assert out == _one_by_one(batches)
    assert state.value is not None or not state.map


def _changes(begin, end, keys):
    return [(7, i, 0, "change", str(i % keys), True, str(i)) for i in range(begin, end)]


def test_the_state_is_not_asked_for_each_row():
    mark = lambda kind, at: (7, at, 1 << 40, kind, None, None, None)
    # no window is open
    assert _run([_changes(0, 1000, 50)])[1].calls == 1
    # a window within a micro-batch
    out, state = _run([[*_changes(0, 1000, 50), mark("low", 100), mark("high", 900)]])
    assert len(out[0]) == 50 and state.calls == 1
    # a window over three of them: by key, not by change, and by nothing that doesn't change
    out, state = _run([[mark("low", -1), *_changes(0, 1000, 50)], _changes(1000, 2000, 2), [mark("high", 2000)]])
    assert [len(x) for x in out] == [0, 0, 50] and sorted(int(x[2]) for x in out[2])[-2:] == [1998, 1999]
    assert state.calls <= 50 + 2 * 3 + 10


def test_arrivals_are_written_in_one_pass_and_read_in_order(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    rows, batches = spark.range(0, 120, 1, 4).select(counted("id").alias("at")), []

    def note(batch, n):
        got = batch.collect()
        batches.append((n, sorted(r["at"] for r in got), len({r["file"] for r in got})))

    named = lambda stream: stream.select("at", F.input_file_name().alias("file"))
    logs._run_arrivals(spark, rows, "at", lambda stream: named(stream).writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")), 3)
    assert [b[:2] for b in batches] == [(i, list(range(40 * i, 40 * i + 40))) for i in range(3)]
    assert min(b[2] for b in batches) > 1
    # once for the highest ordinal and once for all arrivals
    assert seen.value == 240


def test_streams_of_an_empty_log(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert logs.stream_reconcile(spark, str(tmp_path)).collect() == []
    assert logs.stream_passthrough(spark, str(tmp_path)).collect() == []
