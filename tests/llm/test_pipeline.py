from __future__ import annotations

import corpus_pipeline
from keelson.llm import mixing, quality, registry, simhash, toxicity
from keelson.llm.common import BATCH, crc_mod, fresh_dir, table

DIR = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = table(spark, DIR, "documents")
    kept, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near-duplicates", "mixing", "tokens"]
    labels = table(spark, DIR, "labels")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, DIR)
        ids[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, labels.where(crc_mod("doc_id", 3) != 1))
            assert ids[name] == {r["doc_id"] for r in toxicity.classify(docs, model).where("predicted = 0").collect()}
        if name == "quality":
            w = quality.train(kept, labels.where(crc_mod("doc_id", 4) != 2))
            assert ids[name] == {r["doc_id"] for r in quality.classify(kept, w).where("predicted = 1").collect()}
        if name == "near-duplicates":
            assert ids[name] == {r["component"] for r in simhash.near_duplicates(kept).collect()}
        if name == "mixing":
            order = [r["doc_id"] for r in out.collect()]
            placed = mixing.mix(kept, registry.MIX, block_rows=registry.BLOCK_ROWS).orderBy("slot", "in_block").collect()
            assert order == [r["doc_id"] for r in placed]
        kept = out if name == "tokens" else spark.createDataFrame(out.collect(), docs.schema)
    assert ids["tokens"] == ids["mixing"] == ids["near-duplicates"]
    assert {r["doc_id"] for r in registry.pipeline(spark, DIR).select("doc_id").collect()} == ids["tokens"]


def test_the_mix_outlasts_being_written(spark):
    """What run() returns has every document where the mix put it."""
    kept = table(spark, DIR, "documents").repartition(5)
    where = fresh_dir(spark, "mixed")
    corpus_pipeline.mixed(spark, kept, DIR).write.parquet(where)
    want = mixing.mix(kept, registry.MIX, block_rows=registry.BLOCK_ROWS).orderBy("slot", "in_block").collect()
    got = corpus_pipeline.tokens(spark, spark.read.parquet(where), DIR).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(want)))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert sorted(r["position"] for r in registry.pipeline(spark, DIR).collect())[0] == 0


def test_batches_for_workers_are_bounded_unless_the_session_says_otherwise(spark):
    name, default, wanted = BATCH
    spark.conf.unset(name)
    registry.ready(spark)
    assert spark.conf.get(name).rstrip("b") == str(wanted)
    spark.conf.set(name, "1m")
    registry.ready(spark)
    assert spark.conf.get(name) in ("1m", "1048576b")
    spark.conf.unset(name)


def test_odd_documents_pass(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, nothing):
            out = stage(spark, rows, DIR)
            assert out.count() <= rows.count() and (name == "tokens" or out.columns == rows.columns)
