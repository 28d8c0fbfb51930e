from __future__ import annotations

import base64
import gzip
import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import forest, mixing, sharding, topk, warc
from keelson.llm.registry import op7_exact_top_k
from keelson.llm.vectors import search, valid


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i} ü", f"<p>{'same' if i % 3 == 0 else i}</p>" * (1 + i % 5 * (i % 3 > 0))) for i in range(200)]
    rows += [(500, None, None), (501, "u", None), (502, "u", ""), (7, "u", "<p>again</p>"), (7, "u", "<p>again</p>"), (None, "u", "<p>nokey</p>"), (600, "u", "é" * 100_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("shard", F.lit("x"))


def test_warc_round_trip(spark, pages, tmp_path):
    where = f"file://{tmp_path}/a"
    entries = warc.write(pages, where, shard_bytes=4000, roll_bytes=600)
    got, want = warc.read(spark, where).collect(), pages.collect()
    assert len(got) == len(want) and len(entries) > 3
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    data = lambda r: (r["html"] or "").encode()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((r["page_id"] or -1, len(data(r)), sha(data(r))) for r in want)
    first: dict[str, int] = {}
    for r in want:
        if r["page_id"] is not None:
            first[sha(data(r))] = min(r["page_id"], first.get(sha(data(r)), r["page_id"]))
    assert sum(r["record_type"] == "response" for r in got) == len({sha(data(r)) for r in want})
    for r in got:
        if r["record_type"] == "revisit":
            assert r["refers_to"] == first[r["payload_digest"]] and r["payload"] is None
        else:
            assert sha(bytes(r["payload"])) == r["payload_digest"]
    manifest = json.loads(Path(tmp_path, "a/MANIFEST.json").read_text())["files"]
    assert manifest == entries and all(hashlib.sha256(Path(tmp_path, "a", e["file"]).read_bytes()).hexdigest() == e["sha256"] for e in entries)
    assert not list(Path(tmp_path, "a").glob("*.tmp"))
    head = gzip.open(Path(tmp_path, "a", entries[0]["file"])).read(400)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_is_the_same_however_rows_lie(spark, pages, tmp_path):
    a = warc.write(pages, f"file://{tmp_path}/a", shard_bytes=4000, roll_bytes=600)
    b = warc.write(pages.repartition(5), f"file://{tmp_path}/b", shard_bytes=4000, roll_bytes=600)
    assert a == b
    assert warc.write(pages.where("false"), f"file://{tmp_path}/c") == [] and warc.read(spark, f"file://{tmp_path}/c").count() == 0
    warc.write(pages, f"file://{tmp_path}/d", least_bytes=10**9)
    assert len({e["file"][:12] for e in a}) > 10
    assert warc.read(spark, f"file://{tmp_path}/d").where("record_type <> 'response'").count() == 0


def test_warc_of_a_hot_id(spark, tmp_path):
    """Rows of one id, and rows without any, are written by several tasks; equal payloads still are stored once."""
    rows = [(7, "u", f"<p>{i % 90}</p>" * 20) for i in range(180)] + [(None, "u", f"<p>n{i}</p>" * 20) for i in range(60)] + [(1000 + i, "u", f"<p>own {i}</p>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert warc._hot(df) == [7]
    entries = warc.write(df, f"file://{tmp_path}/h", shard_bytes=20_000)
    got = warc.read(spark, f"file://{tmp_path}/h").toPandas()
    of = [set() for _ in range(2)]
    for e in entries:
        with gzip.open(Path(tmp_path, "h", e["file"])) as f:
            heads = [head for head, _ in warc.records(f)]
        of[0].add(e["file"][:12]) if any(h.get("x-page-id") == "7" for h in heads) else None
        of[1].add(e["file"][:12]) if any("x-page-id" not in h for h in heads) else None
    assert len(of[0]) > 3 and len(of[1]) > 3
    own = got[got.page_id == 7]
    assert len(got) == 300 and len(own) == 180 and (own.record_type == "response").sum() == 90 and set(own.refers_to.dropna()) == {7}


@pytest.mark.parametrize("sizes,weights", [({"a": 400, "b": 37, "c": 90}, {"a": 3, "b": 2}), ({"a": 5}, {}), ({"a": 64, "b": 64, None: 64}, {"a": 5, "b": 1}), ({f"s{i}": 20 + i for i in range(12)}, {"s0": 9})])
def test_mix_stays_within_a_block(spark, sizes, weights):
    rows = [(i * 1000 + j, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    blocks = got.drop_duplicates("slot").sort_values("slot")
    assert list(blocks.slot) == list(range(-(-len(blocks) // 1))) and (got.groupby("slot").source.nunique(dropna=False) == 1).all()
    order = [None if s != s or s is None else s for s in blocks.source]
    n = {s: -(-k // 4) for s, k in sizes.items()}
    done, fluid = dict.fromkeys(n, 0), dict.fromkeys(n, 0.0)
    for s in order:
        left = 1.0
        while left > 1e-12 and (live := [x for x in n if fluid[x] < n[x] - 1e-9]):
            total = sum(weights.get(x, 1) for x in live)
            step = min([left, *((n[x] - fluid[x]) * total / weights.get(x, 1) for x in live)])
            for x in live:
                fluid[x] += step * weights.get(x, 1) / total
            left -= step
        done[s] += 1
        assert all(abs(done[x] - fluid[x]) < 1 for x in n)


def _edf(blocks, weights):
    """The sources of all slots: within the fluid schedule's windows, the earliest deadline first, by whole rounds."""
    names, out, done = sorted(blocks), [], dict.fromkeys(blocks, 0)
    for q in range(max(-(-n // weights.get(x, 1)) for x, n in blocks.items())):
        c = [max(0, min(weights.get(x, 1), blocks[x] - q * weights.get(x, 1))) for x in names]
        a = [weights.get(x, 1) for x in names]
        used = lambda i, k: sum(min(a[j] * k, c[j] * a[i]) for j in range(len(a)))
        taken = [0] * len(names)
        for t in range(sum(c)):
            ready = [(-(-used(i, taken[i] + 1) // a[i]), i) for i in range(len(names)) if taken[i] < c[i] and used(i, taken[i]) // a[i] <= t]
            due, i = min(ready)
            assert due > t
            out.append((names[i], done[names[i]]))
            done[names[i]] += 1
            taken[i] += 1
    return out


@pytest.mark.parametrize("rows,weights", [({"a": 700, "b": 300, "c": 41}, {"a": 301, "b": 99, "c": 7}), ({f"s{i:03}": 5 + i % 7 for i in range(90)}, {"s000": 3}), ({"a": 50, "b": 50}, {"a": 400, "b": 200})])
def test_mix_is_the_earliest_deadline_first(spark, rows, weights):
    """Large weights and many sources, against a second implementation."""
    df = spark.createDataFrame([(i * 10_000 + j, s) for i, (s, n) in enumerate(rows.items()) for j in range(n)], "doc_id long, source string")
    got = mixing.mix(df, weights, block_rows=2).toPandas().drop_duplicates("slot").sort_values("slot")
    # weights are in their lowest terms, with the default of 1 among them
    want = _edf({s: -(-n // 2) for s, n in rows.items()}, weights)
    assert list(zip(got.source, got.block)) == want


def test_mix_of_odd_rows(odd, nothing):
    got = mixing.mix(odd, {"a": 2}, block_rows=2)
    assert got.count() == odd.count() and got.select("slot", "in_block").distinct().count() == odd.count()
    back = mixing.mixed(odd, {"a": 2}, block_rows=2)
    assert back.columns == odd.columns and sorted(map(str, back.collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(nothing, {}).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_without_broadcasts(spark, odd, monkeypatch):
    want = {(r["doc_id"], r["slot"], r["in_block"]) for r in mixing.mix(odd.dropDuplicates(["doc_id"]), {"a": 2}, block_rows=2).collect()}
    monkeypatch.setattr(mixing, "FEW", 0)
    assert {(r["doc_id"], r["slot"], r["in_block"]) for r in mixing.mix(odd.dropDuplicates(["doc_id"]), {"a": 2}, block_rows=2).collect()} == want


def test_shards(spark, odd, nothing):
    rows = [(i, "hot text " * 50 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    by = got.groupby("shard")
    sums = by["size"].sum()
    assert len(got) == 1500 and len(by) == 16 and sums.max() < 1.1 * sums.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in by.slot)
    assert got[got.doc_id % 3 > 0].groupby("text_crc32").shard.nunique().max() == 1
    few = sharding.shard(odd).toPandas()
    assert len(few) == odd.count() and set(few["size"]) >= {1, 19}
    assert all(sorted(x) == list(range(len(x))) for _, x in few.groupby("shard").slot)
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_repeated_rows_are_spread(spark, share):
    """Rows that repeat both key and text are dealt alike to shards, and numbered."""
    n = 3000
    rows = [(7, "the same row " * 20) if i < share * n else (100 + i, f"text {i} " + "of its own " * 18) for i in range(n)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == n and len(sums) == 16 and sums.max() < 1.15 * sums.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)


def test_place_takes_the_highest_dot_product():
    items = np.array([[4.0, 1, 1], [3, 1, 1], [2, 1, 1], [1, 1, 1]])
    assert sharding.place(items, 2).tolist() in ([0, 1, 1, 0], [1, 0, 0, 1])


def _vectors(spark, n=400, d=12, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)).astype(np.float32)
    v[5], v[10] = v[4], v[4]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(10000, None), (10020, [1.0, None] + [0.0] * (d - 2)), (10040, [float("nan")] * d), (10060, [float("inf")] * d), (10080, [1.0]), (None, v[0].tolist()), (10100, [0.0] * d), (40, v[40].tolist())]
    return v.astype(np.float64), spark.createDataFrame([(*x, "l") for x in rows + bad], "vec_id long, embedding array<float>, score string")


def test_top_k_is_exact(spark):
    v, df = _vectors(spark)
    got = topk.top_k(df, F.col("key") % 20 == 0).collect()
    w = np.floor(256 * np.vstack([v, v[40:41], np.zeros((1, 12))])).astype(np.int64)
    ids = np.array([*range(400), 40, 10100])
    for q in sorted({r["query_id"] for r in got}):
        s, other = w @ w[ids == q][0], ids != q
        best = np.lexsort((ids[other], -s[other]))[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == list(zip(ids[other][best], s[other][best]))
    assert {r["query_id"] for r in got} == {*range(0, 400, 20), 10100}
    assert topk.top_k(df.where("false"), F.col("key") % 20 == 0).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), F.col("key") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_top_k_of_large_numbers_and_op7_sql(spark):
    rows = [(i, [3e6 + i, -2e6 + 7 * i]) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("key") == 0).collect()
    w = [[int(np.floor(256 * x)) for x in v] for _, v in rows]
    want = sorted(((-sum(a * b for a, b in zip(w[0], w[i])), i) for i in range(1, 60)))[:5]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    assert op7_exact_top_k(spark, "/root/testdata/sf0.001").count() > 0


def test_forest_finds_most_and_scores_exactly(spark):
    v, df = _vectors(spark, 3000, 16)
    rows = valid(df, "vec_id", "embedding", zero=False).where("key <> 40 and key is not null")
    got = forest.neighbours(rows, F.col("key") % 20 == 0, key="key", vector="vector").toPandas()
    hit = total = 0
    for q, x in got.groupby("query_id"):
        s = v @ v[q]
        s[[q, 40]] = -np.inf
        assert list(x["rank"].sort_values()) == list(range(1, 21)) and q not in set(x.vec_id)
        assert np.allclose(x.score, s[x.vec_id])
        hit, total = hit + len(set(x.vec_id) & set(np.argsort(-s)[:20])), total + 20
    assert hit / total >= 0.9
    assert not {10000, 10020, 10040, 10060, 10080, 10100} & set(got.vec_id) | {10100} & set(got.query_id)
    assert forest.neighbours(df.where("false"), F.col("key") % 20 == 0).count() == 0


def test_descent_finds_the_longest_prefix():
    r = np.random.default_rng(4)
    hashes = np.sort(r.integers(0, 1 << 32, (3, 50), dtype=np.uint32), axis=1)
    f = forest.Forest.__new__(forest.Forest)
    f.hashes, f.order = hashes, np.argsort(hashes, axis=1)
    queries = np.concatenate([r.integers(0, 1 << 32, (3, 20), dtype=np.uint32), hashes[:, :2] ^ np.uint32(5)], axis=1)
    want = [max(32 - int(q ^ h).bit_length() for t in range(3) for q in [int(queries[t, i])] for h in map(int, hashes[t])) for i in range(queries.shape[1])]
    assert f.descend(queries).tolist() == want and max(want) >= 29
    # all strings that share as many bits as are needed for enough of them, and no other
    for i, mark in enumerate(f.candidates(queries, 30)):
        for depth in range(32, -1, -1):
            own = {j for t in range(3) for j, h in zip(f.order[t], map(int, hashes[t])) if (int(queries[t, i]) ^ h) >> (32 - depth) == 0}
            if len(own) >= 30 or not depth:
                break
        assert set(np.flatnonzero(mark)) == own


def test_clustered_vectors_need_few_candidates(spark):
    r = np.random.default_rng(8)
    middle = r.normal(size=(60, 24))
    v = (middle[r.integers(0, 60, 4000)] + 0.15 * r.normal(size=(4000, 24))).astype(np.float32).astype(np.float64)
    assert forest.fitted_share(v, 20, forest.projections(24)) <= 1 / 16
    got = forest.neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("key") % 20 == 0).toPandas()
    hit = 0
    for q, x in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(x.vec_id) & set(np.argsort(-s)[:20]))
    assert hit / len(got) >= 0.9 and len(got) == 4000


@pytest.mark.parametrize("search_of", ["topk", "forest"])
def test_widths_ties_and_clashing_columns(spark, search_of, monkeypatch):
    """Each width among its own kind; equal scores of several blocks go to the smaller keys; a column named key does no harm."""
    import keelson.llm.vectors as vectors

    monkeypatch.setattr(vectors, "BLOCK_CELLS", 8)
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100 + i, [3.0, 1.0, float(i % 2)]) for i in range(10)]
    df = spark.createDataFrame([(*x, 9, "v") for x in rows], "vec_id long, embedding array<double>, key int, vector string").repartition(6)
    of = topk.top_k if search_of == "topk" else forest.neighbours
    got = of(df, F.col("key") % 100 == 0, k=5).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == [101, 102, 103, 104, 105] and got[got.query_id == 100].score.nunique() == 1


def test_queries_go_out_in_passes(spark, monkeypatch):
    import keelson.llm.vectors as vectors

    _, df = _vectors(spark)
    want = sorted(map(tuple, topk.top_k(df, F.col("key") % 20 == 0).collect()))
    monkeypatch.setattr(vectors, "QUERY_CELLS", 100)
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 500)
    assert sorted(map(tuple, topk.top_k(df, F.col("key") % 20 == 0).collect())) == want
    assert search is vectors.search
