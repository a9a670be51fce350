"""HTML, BIOES, section trees, layout and tables on small inputs."""

from pyspark.sql import functions as F

from lattica.operators import documents as H
from lattica.operators import layout as L
from lattica.plans import flows

PAGE = """<html><body><nav><p>skip this navigation paragraph because it lies outside of the main part here</p></nav><div id="main"><h1>My <b>Title</b></h1>
<p>Before any heading there are at least eight words in this one.</p><h2>1 Intro</h2><p>Too short.</p><p>We use <mark class="concept">BERT</mark> (Devlin et al., 2019) on eight words or more here.</p><p>Second paragraph of the intro also has more than eight words.</p>
<h2>References</h2><p>This reference paragraph has more than eight words and still goes away.</p><h3>2.1 Sub</h3><p>The subsection text again has at least eight words to stay.</p></div></body></html>"""


def test_html_sections(spark):
    got = {(r.section_ord, r.section): r for r in H.html_sections(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x</p>")], "page_id long, html string")).collect()}
    assert sorted(got) == [(0, "Abstract"), (1, "1 Intro"), (3, "2.1 Sub")]
    assert got[1, "1 Intro"].text == "We use BERT on eight words or more here. Second paragraph of the intro also has more than eight words."
    assert got[0, "Abstract"].title == "My Title"


def test_bioes(spark):
    lines = ["S-METHOD", "O", "B-TASK", "I-TASK", "E-TASK", "B-TOOL", "O", "B-TASK", "I-TOOL", "E-TASK", "I-TASK", "B-DATASET", "I-DATASET"]
    df = spark.createDataFrame([("f", 0, i, f"t{i}", t) for i, t in enumerate(lines)], "file string, rec_no int, tok_no long, token string, tag string")
    strict = sorted((r.start, r.text, r.type) for r in H.decode_bioes(df).collect())
    assert strict == [(0, "t0", "method"), (2, "t2 t3 t4", "task"), (5, "t5", "tool"), (7, "t7", "task"), (11, "t11 t12", "dataset")]
    lax = sorted((r.start, r.text) for r in H.decode_bioes(df, strict=False).collect())
    assert (7, "t7 t8 t9") in lax
    rows = H.entity_csv_rows(H.annotated_papers(df).withColumn("paper_id", F.lit("P1"))).collect()
    assert {r.Entity for r in rows} == {x[1] for x in strict} and {r.CEO_Type for r in rows if r.NER_Type == "tool"} == {"Tool"}


def test_section_tree(spark):
    heads = ["1.1 Lost", "Abstract", "1 Intro", "1.1 Sub", "1.1.1 Deep", "1.1.2 Deep", "1.2 Sub", "2 Method", "2.1.1 Odd", "A Proofs", "A.1 More", "B Data"]
    df = spark.createDataFrame([("d", i, h) for i, h in enumerate(heads)], "doc_id string, ord int, heading string")
    got = [r.sec_id for r in H.section_tree(df).orderBy("ord").collect()]
    assert got == ["S1", "abstract", "S2", "S2.SS1", "S2.SS1.SSS1", "S2.SS1.SSS2", "S2.SS2", "S3", "S3.SSS1", "AA", "AA.SS1", "AB"]


def test_similarity(spark):
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>x</p><p>y</p>"), (2, "<h1>b</h1><p>z</p>")], "page_id long, html string")
    r = H.structure_similarity(spark.createDataFrame([(1, 2)], "a long, b long"), H.tag_counts(pages, "page_id", "html")).first()
    assert abs(r.structure - 0.9) < 1e-12
    v = H.hashed_vectors(spark.createDataFrame([(1, "a b a"), (2, "a b a")], "id long, t string"), "id", "t", 8).collect()
    assert v[0].v == v[1].v and sum(v[0].v) == 3.0


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, 0, x, y, c, t) for i, (x, y, c, t) in enumerate(rows)], "doc_id long, ord long, page int, x double, y double, col int, text string")


def test_lines_merge_onto_their_anchor(spark):
    b = blocks(spark, [(50.0, 100.0, 0, "a"), (52.0, 106.0, 0, "b"), (50.0, 112.0, 0, "c"), (90.0, 114.0, 0, "d")])
    got = [r.text for r in L.merge_lines(b, ["doc_id"]).orderBy("first").collect()]
    assert got == ["a b", "c", "d"]


def test_columns_of_a_page(spark):
    b = blocks(spark, [(50.0 + i % 3, float(i), 0, "left") for i in range(12)] + [(320.0 + i % 2, float(i), 0, "right") for i in range(12)])
    got = {r.text: set() for r in b.collect()}
    for r in L.detect_columns(b, ["doc_id"]).collect():
        got[r.text].add(r.col)
    assert len(got["left"]) == len(got["right"]) == 1 and got["left"] != got["right"]
    few = L.detect_columns(b.limit(5), ["doc_id"]).collect()
    assert {r.col for r in few} == {0}


def test_word_grid(spark):
    w = spark.createDataFrame([(1, 0, 10.0, 5.0, "A"), (1, 1, 60.0, 5.0, "B"), (1, 2, 12.0, 30.0, "C"), (1, 3, 18.0, 31.0, "D")], "p int, ord int, x0 double, top double, text string")
    assert {(r.r, r.c): r.text for r in L.word_grid(w, ["p"]).collect()} == {(0, 0): "A", (0, 1): "B", (1, 0): "C D"}


TABLE = "doc_id long, ord int, page int, headers array<string>, rows array<array<string>>, quality double, source string"


def test_tables_are_told_apart(spark):
    cells = [["BERT", "90.1"], ["GPT", "88.0"]]
    t = spark.createDataFrame(
        [
            (1, 0, 1, ["Model", "F1"], cells, 0.9, "grid"),
            (1, 1, 1, ["Model", "F1"], cells + [["ELMo", "80"]], 0.8, "lines"),
            (1, 2, 2, ["Table 3: x", ""], [["Name", "Value"], ["alpha", "1.5"]], 0.4, "grid"),
            (1, 3, 3, ["References", "x"], [["[1]", "Smith 2019"]], 0.9, "grid"),
            (1, 4, 4, ["Model", "F1", "EM"], [["a", "b", "3"]], 0.3, "grid"),
        ],
        TABLE,
    )
    got = {r.ord: r for r in L.distinct_tables(t, ["doc_id"]).collect()}
    assert sorted(got) == [0, 2, 4] and got[2].headers == ["Name", "Value"] and got[2].quality == 0.6


def test_captions_go_to_tables_in_order(spark):
    t = spark.createDataFrame([(1, 0, 2, ["a"], [["1"]], 1.0, "x"), (1, 1, 2, ["b"], [["1"]], 1.0, "x"), (1, 2, 9, ["c"], [["1"]], 1.0, "x")], TABLE)
    c = spark.createDataFrame([(1, 1, 1, 10.0, "Table 1: one"), (1, 2, 2, 20.0, "Table 2: two")], "doc_id long, num int, page int, y double, text string")
    got = {r.ord: (r.cap_page, r.cap_y, r.caption) for r in L.assign_captions(t, c, ["doc_id"]).collect()}
    assert got == {0: (2, 22.0, "Table 2: two"), 1: (1, 12.0, "Table 1: one"), 2: (9, 500.0, None)}


def test_tables_below_captions(spark):
    text = "Intro prose here.\nTable 2: Results of models\nModel  F1  EM\nBERT  90.1  84\nk\nGPT  88.0  80\nThis is a long line of running prose that surely ends the table because it has no numbers at all.\nX  1  2"
    r = L.caption_tables(spark.createDataFrame([(1, 3, text), (1, 4, "Table 2: again\nA  1\nB  2")], "doc_id long, page int, text string")).collect()
    assert len(r) == 1 and r[0].num == 2 and r[0].page == 3 and r[0].rows[0] == ["BERT", "90.1", "84k"] and r[0].rows[1] == ["GPT", "88.0", "80"]


def test_text_tables_and_unions(spark):
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b c d 1", "e f g h 2", "prose", "x y z w 3"])], "doc_id long, ord int, text string")
    r = L.text_tables(b, ["doc_id"]).collect()
    assert len(r) == 1 and r[0].headers == ["a", "b", "c", "d", "1"] and r[0].rows == [["e", "f", "g", "h", "2"]]
    make = lambda page, q, h: spark.createDataFrame([(1, 0, page, h, [["1", "2"]], q, "s")], TABLE)
    got = L.union_tables(make(1, 0.9, ["a", "b"]), make(2, 0.9, ["a", "b"]), make(2, 0.9, ["a", "b"]).union(make(3, 0.8, ["a", "b"])).union(make(4, 0.5, ["a", "b"])))
    assert sorted(x.page for x in got.collect()) == [1, 2, 3]


def test_paragraphs_merge_like_lines_of_a_column():
    long = "x" * 90
    assert L.merge_paragraphs(["one", "two.", "", "- bullet", 'said "so."', long, "tail"]) == ["one two.", "- bullet", 'said "so."', f"{long} tail"]


def test_parse_corpus(spark):
    rows = [(50.0, 60.0 + 20 * i, 0, t) for i, t in enumerate(["A Very Good Title Of This Paper.", "1 Introduction", "This is the first line of a paragraph,", "and it goes on to the end of it.", "Figure 1: A picture of the whole.", "2 Method", "We use BERT because it works quite well.", "References", "Smith and Jones wrote this in 2019."])]
    t = spark.createDataFrame([], TABLE)
    got = [(r.section_ord, r.heading, r.type, r.text) for r in flows.parse_corpus(blocks(spark, rows), t).orderBy("section_ord", "ord").collect()]
    assert got == [
        (1, "1 Introduction", "paragraph", "This is the first line of a paragraph, and it goes on to the end of it."),
        (1, "1 Introduction", "figure", "Figure 1: A picture of the whole."),
        (2, "2 Method", "paragraph", "We use BERT because it works quite well."),
        (3, "References", "paragraph", "Smith and Jones wrote this in 2019."),
    ]
