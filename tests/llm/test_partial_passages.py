import duckdb

from lattica.llm import decontaminate


def test_all_columns_equal_the_sql_on_partial_passages(spark):
    item = [f"item{i}" for i in range(60)]
    other = [f"other{i}" for i in range(30)]
    prose = [f"prose{i}" for i in range(200)]
    docs = [
        (1, prose[:50] + item[:20] + prose[50:150]),  # only the head
        (2, prose[:50] + item[40:] + prose[50:150]),  # only the tail
        (3, prose[:70] + item[:14] + prose[84:116] + item[46:] + prose[130:]),  # two stretches of one alignment
        (4, prose[:50] + item[:20] + prose[50:60] + other + prose[60:150]),  # beside another item
        (5, item[30:50]),
        (6, prose),
    ]
    bench = [(1, item), (2, other), (3, ["short", "item", "of", "five", "tokens"])]
    docs, bench = ([(i, " ".join(w)) for i, w in x] for x in (docs, bench))
    con = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", bench)):
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    columns = ["doc_id", "item_id", "doc_start", "item_start", "overlap_tokens", "matched_tokens"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({decontaminate.oracle()})").fetchall())
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want
    assert (1, 1, 50, 0, 60, 20) in want


def test_repetitive_text_against_a_repetitive_item(spark):
    """As many alignments as tokens, each of the item's length: the best is the first."""
    docs = spark.createDataFrame([(1, "w " * 6000), (2, "w " * 12), (3, "v w " * 300)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "w " * 40)], "item_id long, text string")
    got = {r.doc_id: tuple(r)[2:] for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {1: (0, 0, 40, 40)}
