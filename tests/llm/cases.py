"""Awkward documents that every operator must take."""

LONG = ("lorem ipsum dolor sit amet. " * 4000) + "x" * 5000
EDGE = [(1, "One small text. It has two sentences."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "twin text here now"), (6, "twin text here now"), (7, "twin text here now"), (None, "no id at all"), (8, "日本語 <|endoftext|> naïve café's İ 🎉")]
#: Columns that share names with what operators make on the way.
CLASH = "'a' AS fp, 'b' AS score, 'c' AS held_out, 'd' AS size, 'e' AS shard, 'f' AS slot, 'g' AS block, 'h' AS component, 'i' AS node, 'j' AS _id, 'k' AS _text, 'l' AS _label, 'm' AS hash, 'n' AS tokens, 'o' AS region, 'p' AS component_id, 'q' AS label, 'r' AS digest"


def edge_docs(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").selectExpr("*", *CLASH.split(", "))


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def key(row):
    return tuple((x is None, x) for x in row)
