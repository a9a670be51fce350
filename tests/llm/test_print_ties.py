"""The near-duplicate stage finds what the SimHash index links, also without its MinHash bands."""

import corpus_pipeline
from test_jaccard import changed_copies, grams, similar

from lattica.llm import jaccard, simhash


def test_index_finds_near_copies_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_band_ties", lambda distinct: distinct.selectExpr("node AS a", "node AS b").limit(0))
    texts = changed_copies(n=8, size=400)
    texts += [texts[0].upper(), "one two", "one  two"]
    fp, sets = [simhash.fingerprint(t.encode()) for t in texts], [grams(t) for t in texts]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= simhash.MOST_BITS and similar(sets[i], sets[j])}
    assert len(close) > 8 and any(sets[i] != sets[j] for i, j in close)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert all(named[i] == named[j] for i, j in close)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, c in named.items() if i == c} and not kept & {i for i, _ in close}
