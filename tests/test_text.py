"""Text rules on literal inputs."""

import re

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions.python_udfs import closest_relation, first_object
from lattica.vocab import RELATIONS


def apply(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.clean_text, ["trans-\nformer", "efﬁcient ­word", "a  b ,c​", "x‑y\n\n\tz"], ["transformer", "efficient word", "a b,c", "x-y z"]),
    (T.clean_html_text, ["Good (Vaswani et al., 2017a) work", "note¹ here 12", " a\n b "], ["Good work", "note here", "a b"]),
    (T.normal_title, ["BERT: Pre-training!", "  A  b "], ["bert pre training", "a b"]),
    (T.normal_entity, [" Deep_Learning  Model ", "BERT"], ["deep learning model", "bert"]),
    (T.display_label, ["deep_learning", "x"], ["Deep learning", "X"]),
    (T.gazetteer_key, ["U-Net, and word2vec!", "--"], ["u-net and word2vec", ""]),
    (T.strip_punctuation, ["(BERT),", "'a b'."], ["BERT", "a b"]),
    (T.detokenised_title, ["A semi - supervised X : part , two", "it ' s"], ["A semi-supervised X: part, two", "it's"]),
    (T.slug, ["A title: with, signs!", "x" * 60], ["A_title__with__signs", "x" * 50]),
    (T.clean_heading, ["2.1  Model", "IV. Experiments", "A.1 Details"], ["2.1 Model", "IV Experiments", "A.1 Details"]),
    (T.strip_thinking, ["<think>a</think>```json\n{}\n```", "<think>never ends {}", "plain"], ["{}", "", "plain"]),
    (T.clean_model_output, ["Cleaned text: One. One. <b>Two</b>.", "A b. C d. C d."], ["One. Two.", "A b. C d."]),
    (T.is_heading, ["1 Introduction", "2.1 Attention Model", "3. Interpretation", "1. All morphemes are created equal.", "IV Experiments", "B.1 Hyperparameters", "RELATED WORK", "AE AS DS DD", "I think so", "A = B C", "Plain text here", "1 In"], [True, True, True, False, True, True, True, False, False, False, False, False]),
    (T.is_garbage, ["AE AS DS DD", "two words", "References", "1 Introduction", "A short line without end", "A short line with end.", "12345 67 89 123 456", None], [True, True, False, False, True, False, True, None]),
    (T.is_table_caption, ["Table 3: x", "figure 1", "table12"], [True, False, True]),
    (T.is_bullet, ["• a", " - b", "c"], [True, True, False]),
    (T.heading_depth, ["Abstract", "1 Intro", "1.2 Sub", "1.2.3 Deep", "A.1 Details", "A Proofs", "IV Results"], [0, 1, 2, 3, 2, 1, 1]),
    (T.heading_class, ["Abstract", "1 Intro", "1.2 Sub", "B Proofs"], ["ltx_abstract", "ltx_section", "ltx_subsection", "ltx_appendix"]),
    (T.is_valid_entity, ["BERT", "ab", "f(x) = 2", "[GM21]", "Lemma 3.1", "this paper", "123", "one two three four five six seven eight nine"], [True, False, False, False, False, False, False, False]),
    (T.is_noise_name, ["the task", "model", "12.3", "BERT", "new thing"], [True, True, True, False, True]),
    (T.is_low_quality_source, ["Too short here.", "See https://x.org for the code of this", "Results are shown in Table 3 for all our models", "We train BERT on the large corpus of books", "John Smith, Mary Jones, Ann Lee, Bob Ray"], [True, True, True, False, True]),
    (T.is_garbled_section, ["E[CLS] E1 E2", "Figure 3", "Acknowledgements", "3 Method"], [True, True, True, False]),
    (T.is_isa_sentence, ["BERT is a model", "They are examples of it", "BERT uses attention"], [True, True, False]),
    (T.is_skipped_section, ["References", "A Appendix of proofs", "Method"], [True, True, False]),
    (T.paper_url, ["1706.03762", "P18-1001", "2020.acl-main.1", "peerj-cs-12", "?"], ["https://arxiv.org/abs/1706.03762", "https://aclanthology.org/P18-1001", "https://aclanthology.org/2020.acl-main.1", "https://peerj.com/articles/peerj-cs-12", None]),
    (T.is_table_row, ["BERT  12.3  4", "Just a line of prose without end", "Self-Attention O(n2·d) O(1) O(1)"], [True, False, True]),
    (T.split_row, ["a   b   c", "one  two", "BERT 12.5 x"], [["a", "b", "c"], ["one", "two"], ["BERT", "12.5", "x"]]),
    (T.kept_cell, ["abc", "accuracy", "BLEU 4", "short", "one two three four five six seven"], [None, "accuracy", "bleu 4", None, None]),
    (T.needs_repair, ["x" * 130, "x" * 130 + "\ny", "a\nb"], [False, True, False]),
    (T.escaped, ["<a & 'b'>"], ["&lt;a &amp; &#x27;b&#x27;&gt;"]),
    (T.is_page_noise, ["12 / 30", "Page 3", "ok text", "Copyright X"], [True, True, False, True]),
]


@pytest.mark.parametrize("rule,values,want", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, rule, values, want):
    assert apply(spark, rule, values) == want


def test_sentences_against_python(spark):
    texts = ["One two three four five. Short one. " + "w " * 170 + "end. Six seven eight nine ten!", "no end at all but five words", ""]
    want = []
    for t in texts:
        out = []
        for s in re.split(r"(?<=[.!?])\s+", t):
            w = s.split()
            if len(w) >= 5:
                out += [s.strip()] if len(w) <= 80 else [" ".join(w[i : i + 80]) for i in range(0, len(w), 80)]
        want.append(out)
    assert apply(spark, T.sentences, texts) == want


def test_packing_against_python(spark):
    parts = ["a" * 700, "b" * 700, "c" * 200, "d" * 1600, "e"]
    got = apply(spark, lambda c: T.packed_paragraphs(c, 1500), [parts, []], "array<string>")
    assert got == [["a" * 700 + " " + "b" * 700, "c" * 200, "d" * 1600, "e"], []]


def test_metrics_entities_and_triples(spark):
    assert [(m.metric, m.value) for m in apply(spark, T.metric_mentions, ["BLEU of 28.4 and F1: 90, 12.5 % more"])[0]] == [("BLEU", 28.4), ("F1", 90.0), ("percentage", 12.5)]
    assert apply(spark, lambda c: T.named_entities(c, F.array(F.lit("deep net"))), ["A Deep Net by Google in Table 2"])[0] == ["deep net", "deep", "net", "google"]
    got = apply(spark, T.rebel_triples, ["<s><triplet> BERT <subj> model <obj> instance of <triplet> x <subj> 1 <obj> r</s>"])[0]
    assert [(t.subject, t.predicate, t.object) for t in got] == [("BERT", "instance of", "model")]


def test_object_in_sentence(spark):
    df = spark.createDataFrame([("the GLUE benchmark", "tested on GLUE tasks"), ("big new data", "nothing here"), ("of the", "x")], "o string, s string")
    assert [r[0] for r in df.select(T.object_in_sentence(F.col("o"), F.col("s"))).collect()] == [True, False, True]


def test_table_rules(spark):
    rows = [
        (["Model", "F1"], [["BERT", "90.1"], ["GPT", "88"]]),
        (["Table 2: x", ""], [["A", "B"]]),
        (["Ref", "x"], [["[1]", "Smith"], ["[2]", "Jones"]]),
        (["aaaaaaa", "b"], [["x", "y"]]),
    ]
    df = spark.createDataFrame(rows, "h array<string>, r array<array<string>>")
    h, r = F.col("h"), F.col("r")
    got = df.select(T.is_valid_table(h, r), T.is_reference_table(h, r), T.has_caption_header(h), T.is_rejected_borderless(h, r), F.round(T.fill_quality(h, r), 2)).collect()
    assert [tuple(x) for x in got] == [(True, False, False, False, 1.0), (False, False, True, True, 0.75), (True, True, False, False, 1.0), (False, False, False, True, 1.0)]


def test_safe_rewrites(spark):
    df = spark.createDataFrame([("the trans- former model works well", "the transformer model works well"), ("short text here", "completely different wording everywhere instead"), ("abc def", "")], "a string, b string")
    assert [r[0] for r in df.select(T.is_safe_rewrite(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_closest_relation_and_json():
    assert closest_relation("used", RELATIONS) == "uses"
    assert closest_relation("trained_on", RELATIONS) == "trainedOn"
    assert closest_relation("evaluetedOn", RELATIONS) == "evaluatedOn"
    assert closest_relation("zzzz", RELATIONS) is None
    assert first_object('x {"a": "}"} y') is None or first_object('{"a": 1}') == '{"a": 1}'
    assert first_object('say {bad} then {"a": {"b": 2}} end') == '{"a": {"b": 2}}'
    assert first_object("nothing") is None
