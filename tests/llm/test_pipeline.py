import re
from collections import defaultdict

import corpus_pipeline
from cases import edge_docs, vocabulary
from test_jaccard import brute
from test_tokens import check_pieces
from tokenizers import Tokenizer

from lattica.llm import quality, toxicity
from lattica.llm.labels import labelled_sample

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]


def test_run_equals_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = quality.fit(*labelled_sample(docs, labels, "quality"))
    rows = [r for r, s in zip(rows, good.scores([t.encode() for _, t in rows]), strict=True) if s >= 0.3]
    bad = toxicity.fit(docs, labels)
    rows = [r for r, s in zip(rows, bad.scores([t.encode() for _, t in rows]), strict=True) if s < 0.5]
    root = brute([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    items = [re.findall(r"[^\W_]+", b.text.lower()) for b in bench.collect()]

    def contaminated(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return any(sum(p == q for p, q in zip(w[a : a + 13], v[c : c + 13], strict=True)) >= 11 for v in items for c in range(len(v) - 12) for a in range(len(w) - 12) if w[a : a + 4] == v[c : c + 4] or w[a + 4 : a + 8] == v[c + 4 : c + 8] or w[a + 8 : a + 12] == v[c + 8 : c + 12])

    rows = [r for r in rows if not contaminated(r[1])]
    lib = Tokenizer.from_file(vocabulary())
    ids = {i: [lib.encode(t, add_special_tokens=False).ids + [0]] for i, t in rows}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), ids)


def test_each_stage_takes_awkward_rows(spark):
    docs = edge_docs(spark)
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs.limit(0), SF).count() == 0
    seen = defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        seen[r.doc_id] += 1
    assert {1, 2, 3, None} <= seen.keys()
