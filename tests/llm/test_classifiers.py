from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import quality, toxicity
from keelson.llm.tokens import mix, words


def _accuracy(scored, marked):
    both = scored.join(marked.select("doc_id", "mark"), "doc_id").toPandas()
    return (both.predicted == both.mark).mean()


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_held_out_accuracy_and_odd_rows(spark, marked, odd, nothing, which):
    op = {"quality": quality, "toxicity": toxicity}[which]
    learn, held = marked.where("doc_id % 4 <> 2"), marked.where("doc_id % 4 = 2")
    labels = learn.select("doc_id", "mark").unionByName(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id long, mark int"))
    model = op.train(marked.select("doc_id", "text"), labels, label="mark")
    assert _accuracy(op.classify(held.select("doc_id", "text"), model), marked) > 0.95
    got = op.classify(odd, model).toPandas()
    assert len(got) == odd.count() and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    same = got[got.text == "One two three four"].score
    assert same.nunique() == 1
    blank = got[got.text.isna() | (got.text.str.strip() == "")].score
    assert blank.nunique() == 1
    assert op.classify(nothing, model).count() == 0
    none = op.train(nothing, labels, label="mark")
    assert set(op.classify(odd, none).toPandas().score) == {0.5}
    assert op.train(marked.select("doc_id", "text"), labels.where("false"), label="mark") is None or which == "quality"


def test_learning_is_the_same_however_rows_lie(marked):
    a = quality.train(marked, marked, label="mark")
    b = quality.train(marked.repartition(7), marked.repartition(3), label="mark")
    assert np.allclose(a, b)
    x, y = toxicity.train(marked, marked, label="mark"), toxicity.train(marked.repartition(7), marked.repartition(3), label="mark")
    assert (x.code == y.code).all() and np.allclose(x.value, y.value) and np.isclose(x.slope, y.slope)


def test_labels_of_one_key_count_once(spark, marked):
    once = toxicity.train(marked, marked, label="mark")
    twice = toxicity.train(marked, marked.unionByName(marked.withColumn("mark", F.lit(0))), label="mark")
    assert (once.code == twice.code).all() and np.allclose(once.value, twice.value)


def test_ftrl_step_is_the_published_one():
    f = quality.Ftrl(bits=2, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    f.step(np.array([1], np.int32), np.array([2.0]), 1)
    # w = 0, p = 1/2, g = -1 for the feature, -1/2 for the bias
    assert np.isclose(f.z[1], -1.0) and np.isclose(f.n[1], 1.0) and np.isclose(f.z[-1], -0.5)
    assert np.isclose(f.weights(np.array([1]))[0], 0.9 / ((1.0 + 1.0) / 0.5 + 0.2))


def _brute(texts, toxic):
    """log P_toxic(w | v) / P_ordinary(w | v) of two Kneser-Ney models, from counters; and the models themselves."""
    mod = 1 << toxicity._HASH
    pairs, marks = [Counter(), Counter()], {}
    for text, c in zip(texts, toxic):
        for _, before, word in toxicity.stream([text]):
            found = list(zip(before.tolist(), word.tolist()))
            least = min(int(mix(np.array([v * mod + w], np.uint64))[0]) for v, w in found)
            for p in found:
                pairs[c][p] += 1
                marks.setdefault(p, [set(), set()])[c].add(int(mix(np.array([least], np.uint64))[0]) % toxicity._MARKS)
    every = set(pairs[0]) | set(pairs[1])
    k, kc, n = Counter(w for _, w in every), [Counter(w for _, w in x) for x in pairs], [Counter() for _ in pairs]
    for c in (0, 1):
        for (v, _), x in pairs[c].items():
            n[c][v] += x
    of = lambda counts: (lambda a, b: min(a / (a + 2 * b), 0.99) if a else 0.5)(*[sum(x == i for x in counts.values()) for i in (1, 2)])
    d, e = [of(x) for x in pairs], [of(x) for x in kc]
    total = [sum(x.values()) for x in kc]

    def chosen(counts, seen, share, least):
        part = []
        for c in (0, 1):
            m = len(seen[c])
            part.append(min(1, (counts[c] if m == toxicity._MARKS else max(m, -toxicity._MARKS * np.log1p(-m / toxicity._MARKS))) / counts[c]) if counts[c] else 0)
        gain = sum(part[c] * counts[c] * np.log(counts[c] / (sum(counts) * s)) for c, s in ((1, share), (0, 1 - share)) if counts[c])
        odds = (counts[1] + 0.5) * (1 - share) / ((counts[0] + 0.5) * share)
        return gain >= least and (odds >= toxicity.RATIO or odds <= 1 / toxicity.RATIO)

    of_word = {}
    for (_, w), m in marks.items():
        both = of_word.setdefault(w, [set(), set()])
        both[0] |= m[0]
        both[1] |= m[1]
    words_kept = {w for w in k if chosen([kc[0][w], kc[1][w]], of_word[w], total[1] / sum(total), toxicity.WORD_GAIN)}
    own = [{w: max(kc[c][w] - e[c], 0) / total[c] for w in words_kept} for c in (0, 1)]
    low = lambda c, w: own[c].get(w, 0) + (1 - sum(own[c].values())) * k[w] / len(every)
    pairs_kept = set()
    for v, w in every:
        x = [n[c][v] * low(c, w) for c in (0, 1)]
        if chosen([pairs[0][v, w], pairs[1][v, w]], marks[v, w], min(max(x[1] / sum(x), 1e-6), 1 - 1e-6), toxicity.PAIR_GAIN):
            pairs_kept.add((v, w))
    high = [{p: max(pairs[c][p] - d[c], 0) / n[c][p[0]] if n[c][p[0]] else 0 for p in pairs_kept} for c in (0, 1)]
    prob = lambda c, v, w: high[c].get((v, w), 0) + (1 - sum(x for p, x in high[c].items() if p[0] == v)) * low(c, w)
    return prob, every, k, words_kept, pairs_kept


@pytest.fixture(scope="module")
def expressions():
    """Texts in which one word, and one pair of common words, are toxic; and copies of a text."""
    r = random.Random(7)
    common = [f"w{i}" for i in range(40)]
    texts, toxic = [], []
    for i in range(240):
        t, line = i % 4 == 0, r.choices(common, k=25)
        at = r.randrange(1, 20)
        line[at : at + 2] = ["red", "fox"] if t else r.choice([["red", "hen"], ["sly", "fox"]])
        if t and i % 8 == 0:
            line.insert(5, "vile")
        texts.append(" ".join(line)), toxic.append(int(t))
    return texts + ["once more this copied line"] * 60, toxic + [1] * 60


def test_kneser_ney_is_that_of_counters(spark, expressions, monkeypatch):
    texts, toxic = expressions
    monkeypatch.setattr(toxicity, "CURVE", 0)
    counts = toxicity.pair_counts(texts, np.array(toxic))
    pairs = spark.createDataFrame([tuple(int(x) for x in r) for r in zip(*counts)], "pair long, c0 long, c1 long, marks int")
    table, base = toxicity.entries(pairs)
    said = {r["code"]: r["value"] for r in table.collect()}
    model = toxicity.Model(np.array(sorted(said)), np.array([said[x] for x in sorted(said)]), base)
    prob, every, k, words_kept, pairs_kept = _brute(texts, toxic)
    assert len(words_kept) and len(pairs_kept) and len(said) < len(every) / 10
    code = {w: next(x[2][0] for x in toxicity.stream([w])) for w in ("copied", "red", "fox", "vile")}
    assert code["vile"] in words_kept and (code["red"], code["fox"]) in pairs_kept and code["copied"] not in words_kept
    for text in [*texts[:12], texts[-1], "red fox vile w1 never seen"]:
        own = [(v, w) for _, before, word in toxicity.stream([text]) for v, w in zip(before.tolist(), word.tolist())]
        known = [(v, w) if w in k else None for v, w in own]
        want = np.mean([np.log(prob(1, *p) / prob(0, *p)) if p else base + said.get(v | toxicity._BEFORE, 0) for p, (v, _) in zip(known, own)])
        assert np.isclose(model.evidence([text])[0], want)
    for v in {v for v, _ in pairs_kept} | {next(iter(every))[0]}:
        assert np.allclose([sum(prob(c, v, w) for w in k) for c in (0, 1)], 1)


def test_toxicity_of_a_pair_needs_its_pair(spark, expressions):
    texts, toxic = expressions
    rows = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(zip(texts, toxic))], "doc_id long, text string, mark int")
    model = toxicity.train(rows, rows, label="mark")
    score = model.scores(["w1 w2 red fox w3 w4 w5 w6", "w1 w2 red hen sly fox w3 w4 w5", "", "w9 w8"])
    assert score[0] >= 0.7 > score[1] and score[2] == score[3] < 0.5


@pytest.mark.parametrize("many", [False, True])
def test_no_entry_is_dropped_for_the_models_size(spark, marked, odd, monkeypatch, many):
    """A model larger than what is sent scores as the sent one does."""
    rows = marked.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    whole = toxicity.train(marked, marked, label="mark")
    want = sorted((r["doc_id"] or 0, r["text"] or "", r["score"]) for r in toxicity.classify(rows, whole).collect())
    monkeypatch.setattr(toxicity, "KEEP", 2)
    if many:
        monkeypatch.setattr(toxicity, "SENT", 0)
        monkeypatch.setattr(toxicity, "SCORED", 0)
    wide = toxicity.train(marked, marked, label="mark")
    assert isinstance(wide, toxicity.Wide)
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["score"]) for r in toxicity.classify(rows, wide).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)


def test_words_are_the_same_in_slices_and_alone():
    text = "Été, the QUICK brown-fox 42 ..." + " word" * 10
    (one,), (two,) = list(words([text])), list(words(["x", text]))
    assert (two.word[two.doc == 1] == one.word).all()
    assert list(words([])) == [] and sum(len(w.word) for w in words(["", " \n"])) == 0
