"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff.

Two interpolated Kneser-Ney models are counted, of the texts labelled toxic and of the ordinary ones:

    P_c(w | v) = [v w is kept] max(n_c(v, w) - D_c, 0) / n_c(v) + lambda_c(v) P_c(w)
    P_c(w)     = [w is kept] max(k_c(w) - E_c, 0) / K_c + lambda_c P(w),        P(w) = k(w) / K

n_c are counts, k_c(w) is the number of distinct words that w follows in class c (its continuation count), K_c their sum;
k and K, without a class, are the shared backoff counts. D_c and E_c are absolute discounts between 0 and 1, each n1 / (n1 +
2 n2) of its class's counts of counts; the lambdas give back what was discounted or isn't kept, so that both models are
distributions. All counts are gathered, those of one too: they are part of the discounts and the shared counts.

What is kept follows relative entropy pruning (Stolcke 1998): an expression has counts of its own in both models if these
gain WORD_GAIN or PAIR_GAIN nats over what backing off says of its classes, and differ from that RATIO times. Any other
one, as all rare ones are, has the shared counts' probability in both models and so says nothing. Of a gain only the part
counts that different texts witness, told apart by the least hash of their pairs of words (MinHash): a text is one
witness however often it repeats the expression, and so are its copies and nearly all of its near copies. The thresholds
are fixed, so evidence of a given strength counts alike in a corpus of any size.

A text's evidence is its length-normalised difference of log-likelihoods; a logistic curve, fitted on at most CURVE labelled
texts that weren't counted, turns it into a score. Evidence is a sum over words of what kept words, kept pairs and the words
before these say: a table of codes and values. At most KEEP entries are sent to executors; texts are joined to a larger table
(Wide). No entry is dropped.

Defined cases: null and empty texts have the evidence of a word that says nothing; rows with a null label or key aren't
learnt from; a key of several labels is toxic if any of them says so; without labelled rows of both classes the score is
0.5; repeated rows count as often as they stand; very long texts are read whole, in slices (a pair doesn't span a slice); other columns are carried by name and never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import sigmoid, strings, table_cut, text_slices
from keelson.llm.tokens import mix, words

#: Nats by which counts of its own must explain a word, or a pair, better than backing off does.
WORD_GAIN, PAIR_GAIN = 8.0, 16.0
#: Times by which a kept expression's odds of being toxic differ from what backing off says.
RATIO = 3.0
#: Most entries (16 bytes each) that are sent to executors.
KEEP = 1 << 20
#: The curve is fitted on one labelled text in SHARE, at most CURVE.
SHARE, CURVE = 5, 4000
#: Labels of at most so many rows (16 bytes each: 64 MB) go to the documents; more of them meet in a shuffle by key.
SENT = 1 << 22
#: Evidence of at most so many texts goes to the documents; more of them meet in a shuffle.
SCORED = 1 << 19
#: Codes of words (alone, and as the one before) beside those of pairs; of a text's length.
_ALONE, _BEFORE, _LENGTH = 1 << 62, 1 << 62 | 1 << 31, -1
_HASH = 31
_START = 1
#: Bits of a class that mark in which texts an expression was.
_MARKS = 16
#: Bounds of expected shares: a pair of a single witness can't gain PAIR_GAIN within them.
_EDGE = 1e-6
#: Distinct pairs that are gathered before they are passed on.
_FLUSH = 1_000_000


def stream(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: the number of the text, the hash of the word before and the hash of each word."""
    for part in words(texts):
        is_word = part.shape < np.uint64(64)
        doc = part.doc[is_word]
        word = (part.word[is_word] >> np.uint64(64 - _HASH)).astype(np.int64)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        if len(doc):
            before[np.concatenate([[True], doc[1:] != doc[:-1]])] = _START
        yield doc, before, word


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _merged(parts: list[Counts]) -> Counts:
    """Counts by distinct pair."""
    pair, c0, c1, marks = (np.concatenate(x) for x in zip(*parts))
    if not len(pair):
        return pair, c0, c1, marks
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[at], np.add.reduceat(c0[order], at), np.add.reduceat(c1[order], at), np.bitwise_or.reduceat(marks[order], at)


def pair_counts(texts: list[str], toxic: np.ndarray) -> Counts:
    """Distinct pairs of words as one number each, their counts in ordinary and in toxic texts, and marks of these texts: of
    ordinary ones in the lower _MARKS bits, of toxic ones in the others."""
    parts: list[Counts] = [(np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3)]
    for doc, before, word in stream(texts):
        of = toxic[doc].astype(np.int32)
        pair = before << _HASH | word
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(mix(pair.astype(np.uint64)), at) if len(doc) else np.zeros(0, np.uint64)
        place = np.repeat((mix(least) % np.uint64(_MARKS)).astype(np.uint32), np.diff(np.append(at, len(doc)))) + np.uint32(_MARKS) * of.astype(np.uint32)
        parts.append(_merged([(pair, 1 - of, of, (np.uint32(1) << place).view(np.int32))]))
    return _merged(parts)


@dataclass
class Model:
    """Sorted codes and what each says, what any word says, and the curve."""

    code: np.ndarray
    value: np.ndarray
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def evidence(self, texts: list[str]) -> np.ndarray:
        """log P_toxic - log P_ordinary of each text over its number of words."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for doc, before, word in stream(texts):
            gain = self._says(word | _ALONE) + self._says(before | _BEFORE) + self._says(before << _HASH | word)
            total += np.bincount(doc, gain, len(texts))
            n += np.bincount(doc, minlength=len(texts))
        return self.base + total / np.maximum(n, 1)

    def _says(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(self.code, wanted), len(self.code) - 1)
        return np.where(self.code[at] == wanted, self.value[at], 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.evidence(texts) + self.offset)


@dataclass
class Wide:
    """A model that is too large to send: its table (code, value)."""

    table: DataFrame
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def evidence(self, texts: DataFrame) -> DataFrame:
        """(h1, h2, evidence) of the distinct texts of column __text, named by two hashes."""
        names = ["h1", "h2", "code", "times"]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole, h1, h2 = strings(batch.column("__text")), batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
                every = np.arange(len(whole))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, np.full(len(whole), _LENGTH), np.zeros(len(whole), np.int64))], names=names)
                for doc, before, word in stream(whole):
                    n = np.bincount(doc, minlength=len(whole))
                    of = np.concatenate([doc] * 3 + [every[n > 0]])
                    code = np.concatenate([word | _ALONE, before | _BEFORE, before << _HASH | word, np.full((n > 0).sum(), _LENGTH)])
                    times = np.concatenate([np.ones(3 * len(doc), np.int64), n[n > 0]])
                    order = np.lexsort((code, of))
                    of, code = of[order], code[order]
                    at = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[of[at]], h2[of[at]], code[at], np.add.reduceat(times[order], at))], names=names)

        asked = _hashed(texts).mapInArrow(ask, "h1 long, h2 long, code long, times long")
        said = asked.join(self.table, "code", "left")
        # repeated texts count as often in both sums
        total, n = F.sum(F.col("times") * F.coalesce("value", F.lit(0.0))), F.sum(F.when(F.col("code") == _LENGTH, F.col("times")).otherwise(0))
        return said.groupBy("h1", "h2").agg((self.base + total / F.greatest(n, F.lit(1))).alias("evidence"))


def _hashed(texts: DataFrame) -> DataFrame:
    text = F.coalesce("__text", F.lit(""))
    return texts.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})


def curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton's method. Evidence is measured in distances of the toxic texts' upper quartile
    from the ordinary ones' median, so that single texts of extreme evidence don't flatten it; the slope in that measure has
    a normal prior of deviation 8."""
    if not len(evidence) or toxic.min() == toxic.max():
        return 1.0, 0.0
    middle = np.median(evidence[toxic == 0])
    scale = np.quantile(evidence[toxic == 1], 0.75) - middle
    if scale <= 0:  # the evidence says nothing
        return 0.0, float(np.log(toxic.mean() / (1 - toxic.mean())))
    x = np.stack([(evidence - middle) / scale, np.ones(len(evidence))], 1)
    beta, ridge = np.zeros(2), np.array([1 / 64, 1e-3])
    for _ in range(100):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (toxic - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)


def discount(ones: int, twos: int) -> float:
    """The absolute discount of counts of which so many are 1 and 2."""
    return min(ones / (ones + 2 * twos), 0.99) if ones else 0.5


def _texts() -> list[Column]:
    """Marks of ordinary and of toxic texts."""
    return [F.bit_count(F.col("marks").bitwiseAND((1 << _MARKS) - 1)), F.bit_count(F.shiftrightunsigned("marks", _MARKS))]


def _witnessed(counts: str) -> list[Column]:
    """The parts of toxic and ordinary counts that different texts witness, as many as the marks let expect; full marks tell of
    any number."""
    n = [F.when(x < _MARKS, F.greatest(x, -_MARKS * F.log1p(-x / _MARKS))).otherwise(F.col(f"{counts}{c}")) for c, x in enumerate(_texts())]
    return [F.least(F.lit(1.0), x / F.col(f"{counts}{c}")) for c, x in enumerate(n)][::-1]


def _gain(toxic: Column, ordinary: Column, share: Column, of_toxic: Column, of_ordinary: Column) -> Column:
    """Nats by which the witnessed counts' own share of toxic ones beats the expected one."""

    def term(n: Column, part: Column, expected: Column) -> Column:
        return F.when(n > 0, n * part * F.log(n / ((toxic + ordinary) * expected))).otherwise(0.0)

    return term(toxic, of_toxic, share) + term(ordinary, of_ordinary, 1 - share)


def _differs(toxic: Column, ordinary: Column, share: Column) -> Column:
    odds = (toxic + 0.5) * (1 - share) / ((ordinary + 0.5) * share)
    return (odds >= RATIO) | (odds <= 1 / RATIO)


def entries(pairs: DataFrame) -> tuple[DataFrame, float] | None:
    """(code, value) of all that is kept, and what any word says, from (pair, c0, c1, marks); None if a class has no words."""
    first, second = F.shiftright("pair", _HASH), F.col("pair").bitwiseAND((1 << _HASH) - 1)
    zero, has = F.lit(0).cast("long"), lambda c: (F.col(c) > 0).cast("long")
    roles = pairs.select(
        F.inline(
            F.array(
                F.struct(first.alias("hash"), zero.alias("k"), zero.alias("k0"), zero.alias("k1"), F.col("c0").alias("n0"), F.col("c1").alias("n1"), F.lit(0).alias("marks")),
                F.struct(second.alias("hash"), F.lit(1).cast("long").alias("k"), has("c0").alias("k0"), has("c1").alias("k1"), zero.alias("n0"), zero.alias("n1"), F.col("marks")),
            )
        )
    )
    word = table_cut(roles.groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("k", "k0", "k1", "n0", "n1")], F.bit_or("marks").alias("marks")), "words")
    ones = lambda names: [F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in names for i in (1, 2)]
    sums = word.agg(*[F.sum(c).alias(c) for c in ("k", "k0", "k1")], *ones(("k0", "k1"))).first()
    if not sums["k0"] or not sums["k1"]:
        return None
    of_pairs = pairs.agg(*ones(("c0", "c1"))).first()
    d, e = ([discount(row[f"{c}{i}_1"], row[f"{c}{i}_2"]) for i in (0, 1)] for c, row in (("c", of_pairs), ("k", sums)))
    toxic, ordinary, share = F.col("k1"), F.col("k0"), F.lit(sums["k1"] / (sums["k0"] + sums["k1"]))
    own = [(F.greatest(F.col(f"k{c}") - e[c], F.lit(0.0)) / sums[f"k{c}"]).alias(f"own{c}") for c in (0, 1)]
    kept = table_cut(word.where((_gain(toxic, ordinary, share, *_witnessed("k")) >= WORD_GAIN) & _differs(toxic, ordinary, share)).select("hash", "k", *own), "kept")
    held = kept.agg(*[F.coalesce(F.sum(f"own{c}"), F.lit(0.0)).alias(f"own{c}") for c in (0, 1)]).first()
    rest = [1 - held[f"own{c}"] for c in (0, 1)]
    base = float(np.log(rest[1] / rest[0]))
    low = [F.coalesce(f"own{c}", F.lit(0.0)) + rest[c] * F.col("k") / sums["k"] for c in (0, 1)]
    alone = kept.select("hash", F.log(low[1] / low[0]).alias("log"))
    # pairs: what their first word and the classes' words say is expected of them
    some = pairs.where(F.greatest(*_texts()) > 1).withColumn("w", second)
    some = some.join(word.select(F.col("hash").alias("v"), "n0", "n1"), first == F.col("v")).join(alone.withColumnRenamed("hash", "w"), "w", "left")
    odds = F.col("n1") * F.exp(F.coalesce("log", F.lit(base)))
    expected = F.greatest(F.least(odds / (odds + F.col("n0")), F.lit(1 - _EDGE)), F.lit(_EDGE))
    toxic, ordinary = F.col("c1"), F.col("c0")
    high = [F.when(F.col(f"n{c}") > 0, F.greatest(F.col(f"c{c}") - d[c], F.lit(0.0)) / F.col(f"n{c}")).otherwise(0.0).alias(f"high{c}") for c in (0, 1)]
    chosen = some.where((_gain(toxic, ordinary, expected, *_witnessed("c")) >= PAIR_GAIN) & _differs(toxic, ordinary, expected))
    chosen = table_cut(chosen.select("pair", "v", "w", *high), "pairs")
    back = chosen.groupBy("v").agg(*[(1 - F.sum(f"high{c}")).alias(f"back{c}") for c in (0, 1)])
    whole = chosen.join(back, "v").join(word.select(F.col("hash").alias("w"), "k"), "w").join(kept.select(F.col("hash").alias("w"), "own0", "own1"), "w", "left")
    both = [F.col(f"high{c}") + F.col(f"back{c}") * low[c] for c in (0, 1)]
    beyond = F.log(both[1] / both[0]) - F.log(F.col("back1") * low[1] / (F.col("back0") * low[0]))
    parts = (
        (alone, F.col("hash").bitwiseOR(F.lit(_ALONE)), F.col("log") - base),
        (back, F.col("v").bitwiseOR(F.lit(_BEFORE)), F.log(F.col("back1") / F.col("back0"))),
        (whole, F.col("pair"), beyond),
    )
    tables = [df.select(code.alias("code"), value.alias("value")) for df, code, value in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]), base


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | Wide | None:
    """The model counted over all labelled rows but those of the curve; None if a class has none."""
    spark = docs.sparkSession
    # a key that many labels and many texts share would join each of these to each of those
    labelled = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max((F.col(label) > 0).cast("int")).alias("__toxic"))
    labelled = labelled.withColumn("__hash", F.xxhash64("__key"))
    size = labelled.count()
    # the curve's keys are those of least hash
    last = labelled.select("__hash").orderBy("__hash").limit(min(CURVE, max(size // SHARE, 1))).agg(F.max("__hash")).first()[0]
    if last is None:
        return None
    for_curve = F.col("__hash") <= last
    texts = docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text"))
    rows = texts.join(F.broadcast(labelled) if size <= SENT else labelled, F.col("__doc") == F.col("__key"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []

        def out() -> pa.RecordBatch:
            pair, c0, c1, marks = _merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (pair, c0.astype(np.int64), c1.astype(np.int64), marks)], names=["pair", "c0", "c1", "marks"])

        for batch in batches:
            toxic = batch.column("__toxic").to_numpy(zero_copy_only=False)
            for at, texts in text_slices(batch.column("__text")):
                held.append(pair_counts(texts, toxic[at : at + len(texts)]))
                if sum(len(x[0]) for x in held) > _FLUSH:
                    # what texts share is merged; only what is left counts as gathered
                    held[:] = [_merged(held)]
                    if len(held[0][0]) > _FLUSH // 2:
                        yield out()
        if held:
            yield out()

    counted = rows.where(~for_curve).select("__text", "__toxic").mapInArrow(counts, "pair long, c0 long, c1 long, marks int")
    pairs = counted.groupBy("pair").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.bit_or("marks").alias("marks")).persist(StorageLevel.DISK_ONLY)
    try:
        found = entries(pairs)
        table = None if found is None else table_cut(found[0], "toxicity")
    finally:
        pairs.unpersist()
    if found is None:
        return None
    # of keys that many rows share, too, at most CURVE texts are fitted
    chosen = labelled.where(for_curve)
    some = texts.join(F.broadcast(chosen) if size <= SENT else chosen, F.col("__doc") == F.col("__key")).select("__text", "__toxic")
    some = some.withColumn("__h", F.xxhash64("__text")).orderBy("__h", "__toxic").limit(CURVE).drop("__h")
    if table.count() > KEEP:
        model = Wide(table, found[1])
        some = _hashed(table_cut(some, "curve"))
        seen = some.join(model.evidence(some.select("__text")), ["h1", "h2"]).select("evidence", F.col("__toxic").alias("toxic")).toPandas()
    else:
        rows = table.toPandas().sort_values("code")
        model = Model(rows.code.to_numpy(), rows.value.to_numpy(), found[1])
        sent = spark.sparkContext.broadcast(model)

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.evidence(strings(batch.column("__text")))), batch.column("__toxic")], names=["evidence", "toxic"])

        seen = some.mapInArrow(evidence, "evidence double, toxic int").toPandas()
    seen = seen.sort_values(["evidence", "toxic"])
    model.slope, model.offset = curve(seen.evidence.to_numpy(), seen.toxic.to_numpy(float))
    return model


def classify(docs: DataFrame, model: Model | Wide | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with columns score (0.5 without a model) and predicted (1, toxic, where the score is at least the threshold)."""
    if isinstance(model, Wide):
        known = table_cut(model.evidence(docs.select(F.col(text).alias("__text"))), "evidence")
        x = F.greatest(F.least(model.slope * F.col("evidence") + model.offset, F.lit(40.0)), F.lit(-40.0))
        known = known.select("h1", "h2", (1 / (1 + F.exp(-x))).alias("__score"))
        rows = _hashed(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")))
        rows = rows.join(F.broadcast(known) if known.count() <= SCORED else known, ["h1", "h2"])
        docs, score = rows.select("__row", "__score"), F.col("__score")
        kept = [F.col(f"__row.`{c}`").alias(c) for c in docs.schema["__row"].dataType.names if c not in ("score", "predicted")]
        return docs.select(*kept, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    if model is None:
        score = F.lit(0.5)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(T.DoubleType())
        def of(text: pd.Series) -> pd.Series:
            return pd.Series(sent.value.scores([x or "" for x in text]))

        score = of(F.col(text))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
