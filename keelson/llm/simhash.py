"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into SEGMENTS segments and mapped to the vector of their bit counts. Two fingerprints that differ in
d bits have vectors at a Manhattan distance of at most d, so a range join of the vectors' grid within the limit loses no
link: every distinct fingerprint looks into the cells around its own (an equi-join on the cell), and the Hamming
distance is verified exactly inside the join. Only distinct fingerprints are joined, copies come back by membership.

Defined cases: null and empty texts, and texts of separators, have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows share a fingerprint; a row without a key keeps its fingerprint, and
its component is the smallest key that isn't null (null if there is none); very long texts are hashed whole in slices;
other columns are carried by name and never read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import table_cut, text_slices
from keelson.llm.components import components

WORDS = 3
MOST = 2
#: Segments for up to MANY distinct fingerprints, and for more: finer cells hold fewer pairs, but have more neighbours.
SEGMENTS, FINE, MANY = 8, 16, 1 << 21
#: Keys of at most so many rows (about 16 MB) go to the documents; more of them meet in a shuffle by key.
SENT = 1 << 20


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half of its shingles' XXH64 hashes."""
    # bytes.lower changes A-Z alone, bytes.split cuts at \x20 and \x09-\x0D alone
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(line, 42)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 15):
        part = np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + (1 << 15)], stops[i : i + (1 << 15)])], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(starts))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for _, texts in text_slices(batch.column("__text")) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(found)], names=["key", "fp"])

    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"key {kind}, fp long")


def _steps(segments: int, most: int) -> list[int]:
    """Differences of packed cells within a Manhattan distance of most, one of each pair of opposites."""
    out = {0}
    for n in range(1, most + 1):
        for where in product(range(segments), repeat=n):
            for sign in product((1, -1), repeat=n):
                out.add(sum(s << (4 * w) for w, s in zip(where, sign)))
    return sorted(x for x in out if x >= 0)


def links(fps: DataFrame, most: int = MOST, segments: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of fps.fp that differ in 1 to `most` bits; most is below 8.

    The segments (by default as many as suit the number of fingerprints) decide the work, not the result."""
    if segments is None:
        segments = SEGMENTS if fps.select("fp").distinct().count() <= MANY else FINE
    width = 64 // segments
    mask = (1 << width) - 1
    cell = sum(((F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask).cast("long"))).cast("long")) * F.lit(1 << (4 * i)) for i in range(segments)), F.lit(0).cast("long"))
    nodes = fps.select("fp").distinct().withColumn("cell", cell)
    # a packed cell plus a packed step names the neighbour alone: difference of counts and step differ by less than 16
    # in every segment, so the packed ones are equal only if they are equal in all
    steps = F.array(*[F.lit(x).cast("long") for x in _steps(segments, most)])
    probes = nodes.select(F.col("fp").alias("a"), F.explode(steps).alias("step"), "cell").select("a", (F.col("cell") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("own"))
    found = probes.join(
        nodes.select(F.col("fp").alias("b"), "cell").hint("shuffle_hash"),
        (probes.cell == nodes.cell) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most) & (~F.col("own") | (F.col("a") < F.col("b"))),
    )
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _groups(docs: DataFrame, key: str, text: str, words: int, most: int) -> DataFrame:
    """(key, fp, component, root): near_duplicates, and the least fingerprint that links reach, which names the group."""
    fps = table_cut(fingerprints(docs, key, text, words), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("key").alias("first"))
    group = components(links(fps, most))
    of = least.join(group, least.fp == group.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    root = of.groupBy(F.col("root").alias("whole")).agg(F.min("first").alias("component"))
    named = of.join(root, of.root == root.whole).select(F.col("fp").alias("__fp"), "component", "root")
    return fps.join(named, fps.fp == named["__fp"]).select("key", "fp", "component", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """(key, fp, component): per row its fingerprint and the smallest key that links reach, its own included."""
    return _groups(docs, key, text, words, most).select("key", "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MOST) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest key and, of several of that key, of the least
    hash of its text. Rows that share a key but not a group are decided on apart.

    Rows without a key have no group to name and stay."""
    rows = docs.where(F.col(key).isNotNull())
    found = _groups(rows, key, text, words, most)
    stays = F.max(F.col("key") == F.col("component")).alias("__stays")
    # what isn't simply kept: keys that go, and keys of several rows of which some stay
    marks = found.groupBy(F.col("key").alias("__marked")).agg(stays, F.count(F.lit(1)).alias("__n")).where(~F.col("__stays") | (F.col("__n") > 1))
    marks = table_cut(marks.select("__marked", "__stays"), "marks")
    size = marks.agg(F.count(F.lit(1)).alias("all"), F.count_if("__stays").alias("again")).first()
    joined = rows.join(F.broadcast(marks) if size["all"] <= SENT else marks, F.col(key) == F.col("__marked"), "left")
    out = joined.where(F.col("__marked").isNull()).select(docs.columns).unionByName(docs.where(F.col(key).isNull()))
    if size["again"]:
        # a key doesn't tell these rows' groups: their fingerprints, found anew, do
        several = marks.where("__stays").select(F.col("__marked").alias("__several"))
        named = found.where(F.col("key") == F.col("component")).join(several, F.col("key") == F.col("__several"), "left_semi")
        named = named.select(F.col("key").alias("__named"), F.col("fp").alias("__named_fp"), F.col("root").alias("__root")).distinct()

        @F.pandas_udf("long")
        def fp(text: pd.Series) -> pd.Series:
            return pd.Series(np.array([fingerprint(x or "", words) for x in text], np.uint64).view(np.int64))

        again = joined.where("__stays").select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"), fp(F.col(text)).alias("__fp"))
        again = again.join(named, (F.col("__key") == F.col("__named")) & (F.col("__fp") == F.col("__named_fp")))
        again = again.groupBy("__root").agg(F.min_by("__row", F.xxhash64("__text")).alias("__row"))
        out = out.unionByName(again.select("__row.*"))
    return out
