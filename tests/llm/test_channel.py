import numpy as np
import pytest
from test_classifiers import toy_docs

from lattica.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = toy_docs(spark)
    return toxicity.fit(docs, labels)


def spaced(text, sep=" "):
    return sep.join(text.replace(" ", ""))


def test_words_within_a_spaced_run(model):
    bad = ["you are a moron", "a gentle moron indeed", "moron reader", "you m0r0n"]
    good = ["a kind reader", "a gentle reader indeed"]
    texts = [spaced(t, s) for t in bad + good for s in (" ", ".", "-")]
    score = model.scores([t.encode() for t in texts])
    assert (score[: 3 * len(bad)] >= 0.5).all() and (score[3 * len(bad) :] < 0.5).all()


def test_spans_of_any_length(model):
    kind = "a kind and gentle reader indeed "
    bad = [spaced(kind * 3 + "you are a moron " + kind * 3), "reader-" * 30 + "m0r0n" + "-reader" * 30, "x" * 5000 + "-m0r0n", "m" + "o" * 5000 + "ron"]
    good = [spaced(kind * 6), "reader-" * 60 + "r3ader", "a" * 5000, "1" * 20000 + "a"]
    score = model.scores([t.encode() for t in bad + good])
    assert (score[: len(bad)] >= 0.5).all() and (score[len(bad) :] < 0.5).all()


def test_spaced_reading_equals_all_paths():
    rng = np.random.default_rng(0)
    cost = rng.random((toxicity.SYMBOLS,) * 3) * 5

    def paths(span, i=0, text="", c=0.0):
        if i == len(span):
            yield text, c
            return
        for out, step, j in toxicity.lattice(span, True)[i]:
            yield from paths(span, j, text + out, c + step)

    def total(text, c):
        s = [0, 0, *map(toxicity.symbol, text), 0]
        return c + sum(cost[s[k], s[k + 1], s[k + 2]] for k in range(len(s) - 2))

    for span in ("a b c d", "m 0 r 0 n", "1 a.b"):
        want = min(total(t, c) for t, c in paths(span))
        found = toxicity.viterbi(span, cost, True, {})
        assert any(t == found and abs(total(t, c) - want) < 1e-9 for t, c in paths(span))


def brute_restorations(text, model):
    """The readings of disguised tokens and spaced runs, found character by character; tokens are read by trying every
    path of their lattice and every known word among the paths."""
    cost, known = model.channel.cost, model.channel.known
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    letter = lambda c: c.isalpha() if ord(c) < 128 else True
    sign = lambda c: c in toxicity.STANDS_FOR and ord(c) < 128
    white = lambda c: ord(c) <= 32

    def paths(span, i=0, out="", c=0.0):
        if i == len(span):
            yield out, c
            return
        for piece, step, j in toxicity.lattice(span, False)[i]:
            yield from paths(span, j, out + piece, c + step)

    def total(out, c):
        s = [0, 0, *map(toxicity.symbol, out)]
        s += [0] if s[-1] != 0 else []
        return c + sum(cost[s[k], s[k + 1], s[k + 2]] for k in range(len(s) - 2))

    def best(span):
        found = [(total(o, c), o) for o, c in paths(span)] + [(c + toxicity.KNOWN_COST, o) for o, c in paths(span) if known.get(o)]
        return min(found)[1] if found else span

    out, token = [], ""
    for c in text + " ":
        if not white(c):
            token += c
            continue
        pairs = list(zip(token, token[1:], strict=False))
        if any(letter(a) and sign(b) or sign(a) and letter(b) for a, b in pairs) or any(a == b == d and letter(a) and ord(a) < 128 for a, b, d in zip(token, token[1:], token[2:], strict=False)):
            out.append(best(token.lower().strip("\"'.,;:?#%&()[]{}-_~^=/\\<>").rstrip("!$*+|")))
        token = ""
    padded = "\n" + text + "\n\n"
    apart = lambda c: c in toxicity.SEPARATORS or white(c)
    lone = [0 < i < len(padded) - 1 and (letter(c) or sign(c)) and ord(c) < 128 and c not in toxicity.SEPARATORS and apart(padded[i - 1]) and apart(padded[i + 1]) for i, c in enumerate(padded)]
    i = 0
    while i < len(padded):
        if lone[i] and not (i >= 2 and lone[i - 2]):
            j = i
            while j + 2 < len(padded) and lone[j + 2]:
                j += 2
            if j - i >= 4:
                t = padded[i : j + 1].lower()
                out += [toxicity.viterbi(x, cost, True, known) for x in (t, t[2:], t[:-2])]
        i += 1
    return out


def brute_score(text, model):
    low, miss = text.lower(), 1 - model.base
    restored = brute_restorations(text, model)
    best = {}
    for (f, (least, per)), p in model.rules.items():
        stem, n = f.lstrip("^"), 0
        for s in (low, "\n".join(restored)):
            for k in range(len(s) - len(stem) + 1):
                if s.startswith(stem, k) and not (k and s[k - 1].isalpha()):
                    n += f.startswith("^") or not s[k + len(stem) : k + len(stem) + 1].isalpha()
        if n >= least and n * per >= (len(low.split()) if per else 0):
            best[stem] = max(best.get(stem, 0), p)
    for p in best.values():
        miss *= 1 - p
    return 1 - miss


def test_query_scores_equal_brute_force(spark, model):
    docs, labels = toy_docs(spark)
    texts = ["m0r0n", "you M0R0N!!", "an m o r o n x", "moooooron", "m.o.r.o.n", "m*ron and m*ron", "a gentle reader", "2.0 4.0 (555) 12-34", "", "*** $$$ !!!", "y o u a r e a m o r o n", "morons are moronic", "$o k1nd", "é0é aaa bbb", "i n d e e d", "MORON\tmoron\nMoron", "a b c", "a b c d"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)] + [(i + 100, r.text) for i, r in enumerate(docs.limit(20).collect())]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), docs, labels).collect()
    want = {i: brute_score(t or "", model) for i, t in rows}
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    assert {round(r.score, 3) > 0.5 for r in got} == {True, False}
