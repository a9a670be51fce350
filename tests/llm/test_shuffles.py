"""What the pipeline's stages shuffle: texts and shingle sets of the rows that a join must decide about, not of all."""

import contextlib
import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def without_broadcasts(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables too large to broadcast
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def long_texts(spark, n=240, words=3000):
    """Long texts that have nothing in common, and a near copy of every twentieth."""
    r = random.Random(8)
    out = []
    for i in range(n):
        text = " ".join(f"{r.randrange(1 << 40):x}" for _ in range(words))
        out += [(i, text)] + ([(n + i, f"{text} more")] if i % 20 == 0 else [])
    return spark.createDataFrame(out, "doc_id long, text string").repartition(4), sum(len(t) for _, t in out), n


def test_near_duplicates_ships_the_sets_of_groups_only(spark, tmp_path):
    docs, size, n = long_texts(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with without_broadcasts(spark):
        before = shuffled(spark)
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()} == set(range(n))
        corpus_pipeline.drop_near_duplicates(spark, docs, SF).write.parquet(str(tmp_path / "kept"))
        assert shuffled(spark) - before < 0.6 * 2 * size  # two runs


def test_decontamination_ships_the_texts_of_hits_only(spark, tmp_path):
    docs, size, n = long_texts(spark)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs.selectExpr("doc_id", f"CASE WHEN doc_id % 50 = 0 THEN text || ' ' || \"{item}\" ELSE text END AS text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with without_broadcasts(spark):
        before = shuffled(spark)
        corpus_pipeline.drop_contaminated(spark, docs, SF).write.parquet(str(tmp_path / "kept"))
        assert shuffled(spark) - before < 0.3 * size
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {r.doc_id for r in docs.select("doc_id").collect() if r.doc_id % 50}
