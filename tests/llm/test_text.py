from __future__ import annotations

import base64
import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import bpe, html, labelled_pages, simhash
from keelson.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.Bpe(bpe.read_ranks(PATH), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text(alphabet="ab 'stre\n\t1,é中", max_size=60), max_size=6))
def test_bpe_is_that_of_the_library(both, texts):
    own, library = both
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_long_matches_and_other_patterns(both):
    own, library = both
    texts = ["x" * 3000, "ab" * 400 + "é" * 700, " " * 2000 + "a", "I'll they've we're 's''t", ""]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    other = bpe.Bpe(own.ranks, r"\S+|\s+")
    split = tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=own.ranks, special_tokens={})
    assert [x.tolist() for x in other.encode(texts)] == [split.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        own.decode(np.array([10**6], np.int32))


def test_bpe_forgets_and_goes_on(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "GROUP", 40)
    texts = [f"word{i} and more{i * 7} of it" for i in range(50)]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_digests(both, odd, nothing):
    library = both[1]
    got = bpe.digests(odd, PATH, public_tokenizers.PATTERN).collect()
    want = sorted((r["doc_id"] or 0, hashlib.sha256(" ".join(map(str, library.encode_ordinary(r["text"] or ""))).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.select("doc_id", "text").collect())
    assert sorted((r["doc_id"] or 0, r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN, out="t"), PATH, public_tokenizers.PATTERN, ids="t").select("text", "decoded").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [] if not w else [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aB \n\x0b\x1c ", max_size=40))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


@pytest.mark.parametrize("segments", [8, 16])
def test_links_are_all_pairs_within_reach(spark, segments):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    values = {0, 2**64 - 1} | {int(x) for x in base}
    for x in list(values):
        for n in (1, 2, 3):
            y = x
            for b in r.choice(64, n, replace=False):
                y ^= 1 << int(b)
            values.add(y)
    signed = [int(np.uint64(x).view(np.int64)) for x in values]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(x,) for x in signed * 2], "fp long"), segments=segments).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_near_duplicates_and_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r["key"], r["component"]) for r in got}
    assert (5, 1) in by and (3, 2) in by and (6, 2) in by and (2, 2) in by
    kept = simhash.keep_one(odd).collect()
    # two rows of key 1 are of groups of their own: rows are decided on by group, not by key
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:11]) for r in kept) == [(0, "no key here"), (1, "One two thr"), (1, "another tex"), (2, ""), (4, "lorem ipsum")] and all(r["slot"] == "x" for r in kept)
    assert simhash.keep_one(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_one_row_of_each_group_stays_whatever_keys_they_share(spark, swap):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    a, b = (b, a) if swap else (a, b)
    kept = simhash.keep_one(spark.createDataFrame([(3, b), (5, a), (5, b), (9, a), (9, "a third text of its own"), (9, "a third text of its own")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(3, b), (5, a), (9, "a third text of its own")])
    own = spark.createDataFrame([(7, f"{i} text {i * i} of its {i + 1} own {i * 31}") for i in range(40)], "doc_id long, text string")
    assert simhash.keep_one(own).count() == len({r["fp"] for r in simhash.near_duplicates(own).collect()})


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (None, 1)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_components_of_a_hub_and_of_nothing(spark):
    hub = spark.range(1, 3000).selectExpr("id as a", "0L as b").unionByName(spark.range(1, 500).selectExpr("id as a", "id + 5000 as b"))
    assert {r["root"] for r in components(hub).collect()} == {0} and components(hub).count() == 3000 + 499
    assert components(hub.where("false")).count() == 0


def test_main_text_of_held_out_layouts():
    pages = labelled_pages.pages(150, seed=99)
    blocks, labels = html.labelled(pages)
    hit = total = 0
    for found, y, p in zip(blocks, labels, html.model().label(blocks), strict=True):
        hit, total = hit + int((y == p).sum()), total + len(found)
    assert hit / total > 0.95


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(0)
    crf = html.Crf(r.normal(size=1 << html.BITS), r.normal(size=(2, 2, 2)))
    for n in (1, 2, 5):
        page = [html.Block("t", (), 0, [int(x) for x in r.integers(0, 1 << html.BITS, 3)], bool(r.integers(2)) and i > 0) for i in range(n)]
        score = lambda y: sum(crf.emit[b.features].sum() for b, v in zip(page, y) if v) + sum(crf.move[int(page[i].same), y[i - 1], y[i]] for i in range(1, n))
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=score)
        assert np.isclose(score(crf.label([page])[0].tolist()), score(best))


def test_pages(spark, odd):
    art = "<html><head><title>T</title><script>x('<p>no</p>')</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First  paragraph of\n the text, long enough to read.</p><p>Second one, with <b>bold</b> words inside it.</p></article><footer>&copy; 2020 site.example.com</footer></body></html>"
    rows = [(1, "u", art), (1, "u", art), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text that goes on for a while, as an article does."), (None, "u", "<script>only()"), (5, "u", "<!-- never closed " + "x" * 10)]
    got = html.extract(spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A & B\nFirst paragraph of the text, long enough to read.\nSecond one, with bold words inside it."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)
    assert {r["text"] for r in got if r["page_id"] in (2, 3, 5, None)} == {""}


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<math/>", "<object data=x>", "<canvas>", "<noscript>", "<svg><title/></svg>", "<svg><title>t</svg>", "<style-guide>", "<p data-x=don't>", "<p title=a=b'c>", "<!-->", "<!--->", "<!-- c --!>", "<script>x</script foo>", "<title>a<b</title>", '<p title="never closed>', "<a =>", "<!doctype x>", "</>"])
def test_no_element_but_scripts_styles_and_comments_swallows_the_page(tag):
    found = [b.text for b in html.blocks(f"<p>before</p>{tag}<p>after one</p><p class='x>y'>it's after</p>")]
    assert found == ["before", "after one", "it's after"]


def test_markup_that_nothing_ends_is_no_text():
    for tail in ("<a href=\"x", "<a href='x' title", "<!-- open", "<script>x", "<style>y", "</p", "<!doctype"):
        assert [b.text for b in html.blocks(f"<p>text 1 < 2</p>{tail}")] == ["text 1 < 2"]


@pytest.mark.parametrize("unit", ['<p x="', "<a b='", "<", "<a ", "<!--", "<script>", "</script", "<a =\"", "<p>", "<div>", "<li>a", "<div><p>x", "<p a='>b", "<title>", "<a x='y' ", "</"])
def test_hostile_pages_take_time_in_proportion(unit):
    """A megabyte of anything takes seconds at most; a quadratic scan would take hours."""
    began = time.process_time()
    found = html.blocks(unit * (1_000_000 // len(unit)) + "<p>end")
    html.featurise(found)
    assert time.process_time() - began < 30 and all(len(b.path) <= html.DEEPEST for b in found)


def test_text_is_kept_however_deep(spark, nothing):
    page = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>"
    assert [b.text for b in html.blocks(page)] == ["deep", "after"] and len(html.blocks(page)[1].path) == 1
    long = "<article><h1>Title of it</h1>" + "".join(f"<p>Paragraph {i} has a number of words, as articles do.</p>" for i in range(20_000)) + "</article>"
    got = html.extract(spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")).first()
    assert got["text"].count("\n") == 20_000 and got["n_chars"] == len(got["text"])
    empty = html.extract(nothing.selectExpr("doc_id as page_id", "source as url", "text as html"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]

def test_only_scripts_styles_and_comments_are_dropped():
    page = "<p>area <math><mi>x</mi></math> m</p><noscript>plain words</noscript><object data=x>stand-in</object><script>a</script ><style>b</style><!-- c -->end<script>open"
    assert [b.text for b in html.blocks(page)] == ["area x m", "plain words", "stand-in", "end"]
