"""The opN queries themselves, by their contracts, on the smaller tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash

from keelson.llm import html, labelled_pages, quality, registry, sharding
from keelson.llm.tokens import words

DIR = "/root/testdata/sf0.001"
LABELS = "/root/testdata/sf0.01"
COLUMNS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_source_mixing": "doc_id bigint, source string, block bigint, round bigint, slot bigint, in_block bigint",
    "op7_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_hash_prefix_forest": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def of(name, where=DIR):
        if (name, where) not in kept:
            df = registry.queries()[name](spark, where)
            kept[name, where] = (df.dtypes, df.toPandas())
        return kept[name, where]

    return of


@pytest.fixture(scope="module")
def documents(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(result, name):
    assert ", ".join(f"{c} {k}" for c, k in result(name)[0]) == COLUMNS[name]


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_as_duckdb(result, duck, name):
    got, want = result(name)[1], duck.sql(registry.oracle_sql()[name]).df()
    cell = lambda v: None if pd.isna(v) else v
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name,label,m,rest,recall,alarms", [("op1_quality_classifier", "quality", 4, 2, 0.9, 0.15), ("op3_toxicity", "toxic", 3, 1, 0.6, 0.01)])
def test_scores_of_held_out_labels(result, name, label, m, rest, recall, alarms):
    """On labels that were never learnt from."""
    got = result(name, LABELS)[1]
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{LABELS}/labels.parquet'").fetchall())
    assert got.doc_id.is_unique and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % m == rest for i in got.doc_id]).all()
    held = got[got.held_out & got.doc_id.isin(labels)]
    true = held.doc_id.map(labels)
    assert held.predicted[true == 1].mean() >= recall and held.predicted[true == 0].mean() <= alarms


def test_op1_is_ftrl_by_dictionaries():
    """Sequential updates of McMahan et al., feature by feature."""
    texts = ["a good text of words", "junk junk 99 %%", "good words again", "99 junk"] * 3
    rows = [(*quality.vector(t), i % 2 ^ 1) for i, t in enumerate(texts)]
    model = quality.Ftrl(bits=quality.BITS)
    got = model.fit(rows, epochs=2)
    z, n, order = {}, {}, np.random.default_rng(7)
    alpha, beta, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x = {**{int(f): float(v) for f, v in zip(rows[i][0], rows[i][1])}, 1 << quality.BITS: 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - rows[i][2]) * v
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[f]
                n[f] = old + g * g
    assert all(np.isclose(got[f], weight(f), atol=1e-5) for f in z) and np.count_nonzero(got) <= len(z)
    score = quality.scores(texts[:2], got)
    want = [1 / (1 + np.exp(-(got[-1] + sum(got[f] * v for f, v in zip(*quality.vector(t)))))) for t in texts[:2]]
    assert np.allclose(score, want, atol=1e-5)
    assert len(list(words(texts[:1]))) == 1


def test_op2_finds_the_main_text_of_held_out_layouts():
    """Whole texts of pages that weren't fitted on."""
    pages = labelled_pages.pages(200, seed=4711)
    found, labels = html.labelled(pages)
    want = ["\n".join(b.text for b, y in zip(page, of) if y) for page, of in zip(found, labels)]
    got = html.main_texts([p.replace("\x01", "").replace("\x02", "") for p in pages], html.model())
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.8
    shared = [len(set(a.split("\n")) & set(b.split("\n"))) / max(len(set(a.split("\n")) | set(b.split("\n"))), 1) for a, b in zip(got, want)]
    assert np.mean(shared) > 0.95


def test_op5_is_the_library(result, documents):
    path = public_tokenizers.path(registry.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result("op5_byte_bpe")[1].set_index("doc_id")
    assert len(got) == len(documents)
    for i, text in documents.items():
        ids = library.encode_ordinary(text)
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_op8_by_brute_force(result, documents):
    def fingerprint(text):
        w = text.encode().lower().split()
        each = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in each]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    of = {i: fingerprint(t) for i, t in documents.items()}
    root = {i: i for i in of}
    changed = True
    while changed:
        changed = False
        for a in of:
            for b in of:
                if (of[a] ^ of[b]).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    got = result("op8_simhash")[1]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{of[i]:016x}", root[i]) for i in of}


def test_op9_is_the_greedy_placing(result, documents):
    """By a second implementation, over the groups that are placed by themselves and the cells that hold the others."""
    got = result("op9_sharding")[1].set_index("doc_id")
    size = {i: len(t.encode()) + 1 for i, t in documents.items()}
    assert dict(got["size"]) == size and {i: zlib.crc32(t.encode()) for i, t in documents.items()} == dict(got.text_crc32)
    groups: dict[str, list[float]] = {}
    total = [0, 0, 0]
    for i, t in documents.items():
        more = [size[i], len(t.encode().split()), 1]
        total = [a + b for a, b in zip(total, more)]
        key = hashlib.md5(t.encode()).hexdigest()
        groups[key] = [a + b for a, b in zip(groups.get(key, [0, 0, 0]), more)]
    items: dict[str, list[float]] = {}
    for key, x in groups.items():
        alone = any(a * sharding.CELLS >= b for a, b in zip(x, total))
        name = key if alone else f"cell {int(key[:8], 16) % sharding.CELLS}"
        items[name] = [a + b for a, b in zip(items.get(name, [0, 0, 0]), x)]
    assert all(x[m] * 16 <= total[m] for x in items.values() for m in range(3))  # none is cut
    names = sorted(items)
    part = {k: [x * 16 / t * w**0.5 for x, t, w in zip(items[k], total, sharding.WEIGHTS)] for k in names}
    left = [[w**0.5 for w in sharding.WEIGHTS] for _ in range(16)]
    shard = {}
    for k in sorted(names, key=lambda k: (-sum(part[k]), names.index(k))):
        dots = [sum(a * b for a, b in zip(x, part[k])) for x in left]
        shard[k] = s = max(range(16), key=lambda s: (dots[s], -s))
        left[s] = [a - b for a, b in zip(left[s], part[k])]
    want = {i: shard.get(k := hashlib.md5(t.encode()).hexdigest(), shard.get(f"cell {int(k[:8], 16) % sharding.CELLS}")) for i, t in documents.items()}
    assert np.mean([got.shard[i] == want[i] for i in documents]) > 0.99  # sums in another order may break near ties apart
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard")) and set(got.law) == {"bytes"}
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and got.grown_shard.isna().all()


def test_op10_recall_and_scores(result, duck):
    vectors = {i: np.array(v, float) for i, v in duck.sql("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall()}
    ids, m = np.array(list(vectors)), np.stack(list(vectors.values()))
    got = result("op10_hash_prefix_forest")[1]
    hit = 0
    for q, x in got.groupby("query_id"):
        s = m @ vectors[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(best) & set(x.vec_id))
        assert np.allclose(x.score, [vectors[v] @ vectors[q] for v in x.vec_id])
        assert list(x.sort_values("rank").score) == sorted(x.score, reverse=True)
    assert hit / len(got) >= 0.9 and set(got.query_id) == {i for i in vectors if i % 20 == 0}
