import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import EDGE, edge_docs, empty_docs, key, vocabulary
from tokenizers import Tokenizer

from lattica.llm.bpe import BpeTransducer, machine
from lattica.llm.packing import best_cuts, candidates, pack
from lattica.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def sample(n=1500):
    r = random.Random(0)
    letters = "abst'rvelmd  \n\t1２é!.? 日🎉"
    fixed = ["", "it's we're they'll I'd 's  's\t's !'s ''s 're'x", "  \n\n x \t y  ", "<|endoftext|> a<|endoftext|>", "a <|endoftext|>b", " " * 3000, "\x00a\x00", "a\x00", "'", "'l", "'r", "é　y", "x" * 5000]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_transducer_gives_the_librarys_tokens(library):
    texts, bpe = sample(), BpeTransducer(vocabulary())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time with warm transitions
        ids, counts, _, first = bpe.tokens_of([t.encode() for t in texts])
        end = np.concatenate([[0], np.cumsum(counts)])[first]
        assert [ids[a:b].tolist() for a, b in zip(end, end[1:], strict=False)] == want
    assert bpe.counts_of([t.encode() for t in texts]).tolist() == [len(x) for x in want]


def test_transducer_survives_a_full_table(library):
    bpe = BpeTransducer(vocabulary(), capacity=64)
    for part in (sample(200)[i : i + 20] for i in range(0, 200, 20)):
        assert bpe.counts_of([t.encode() for t in part]).tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_state_maps_compose_over_long_runs(library):
    bpe = BpeTransducer(vocabulary())
    for text in ("word " * 40_000 + "'s" * 3000 + " " * 5000 + "end", "y" * 700 + "1" * 129 + "'" * 300 + "'re" * 99, "x" * 63 + " a", "x" * 64 + "'ll"):
        assert bpe.counts_of([text.encode(), b"", text.encode()]).tolist() == [len(library.encode(text, add_special_tokens=False).ids), 0, len(library.encode(text, add_special_tokens=False).ids)]


def test_no_text_fills_the_table(library):
    """One text of more different words than the table has room for, small and at the real capacity (20 MB)."""
    r = random.Random(5)
    words = [f"{r.getrandbits(40):x}" for _ in range(1_850_000)]
    for capacity, own in ((64, words[:3000]), (1 << 20, words)):
        bpe, text = BpeTransducer(vocabulary(), capacity=capacity), " ".join(own).encode()
        parts = [" ".join(own[i : i + 50_000]) for i in range(0, len(own), 50_000)]
        want = [i for k, p in enumerate(parts) for i in library.encode((" " if k else "") + p, add_special_tokens=False).ids]
        ids, counts, _, first = bpe.tokens_of([text])
        assert ids.tolist() == want and counts.sum() == len(want) and first.tolist() == [0, len(counts)]
        assert bpe.counts_of([text]).tolist() == [len(want)] and bpe.used <= bpe.slots * 3 // 4
        assert bpe._counts([text[:4_000_000]]).tolist() == bpe.counts_of([text[:4_000_000]]).tolist()


def test_long_texts_are_cut_where_pieces_start(library):
    """A window of 16 bytes cuts nearly everywhere that a cut is allowed."""
    texts = sample(200)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        bpe = machine(vocabulary())
        parts = [p for ps, _ in bpe.windows([text.encode()], most=16) for p in ps]
        assert b"".join(parts) == text.encode()
        assert bpe._counts(parts).sum() == len(want.ids)


def test_count_tokens(spark, library):
    got = count_tokens(edge_docs(spark), vocabulary()).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in EDGE]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert count_tokens(empty_docs(spark), vocabulary()).count() == 0


def check_pieces(rows, ids):
    """Every id lies in exactly one piece, sequences are gapless, and each piece is what its document says there."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, own in by_doc.items():
        whole = ids[d]
        copies = max(1, sum(r.length for r in own) // len(whole[0]))
        assert sum(r.length for r in own) == sum(map(len, whole)) and copies == len(whole)
        assert sorted(p for r in own for p in range(r.start, r.start + r.length)) == sorted(p for w in whole for p in range(len(w)))
        for r in own:
            assert r.doc_tokens == len(whole[0]) and zlib.crc32(np.array(whole[0][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        n = sum(r.length for r in own)
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    return padding


def test_pack(spark, library):
    rows = pack(edge_docs(spark), vocabulary()).collect()
    ids = defaultdict(list)
    for d, t in EDGE:
        ids[d].append(library.encode(t or "", add_special_tokens=False).ids + [0])
    check_pieces(rows, ids)
    assert pack(empty_docs(spark), vocabulary()).count() == 0


def test_pack_real_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: [library.encode(r.text, add_special_tokens=False).ids + [0]] for r in docs.collect()}
    rows = pack(docs, vocabulary()).collect()
    assert check_pieces(rows, ids) < 0.02 * sum(len(x[0]) for x in ids.values())
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(1)
    for _ in range(30):
        n, length = 120, 16
        sentence, document = np.unique(r.integers(1, n, 20)), np.unique(r.integers(1, n, 6))
        at, penalty = candidates(sentence, document, n)
        at, penalty = np.unique(np.concatenate([at, np.arange(0, n + 1, 5)])), None
        penalty = r.integers(0, 9, len(at))
        cuts = best_cuts(at, penalty, length)
        cost = {0: 0}
        place = at.tolist()
        for k in range(1, len(place)):
            cost[k] = min(cost[i] + length - (place[k] - place[i]) + penalty[k] for i in range(k) if place[k] - place[i] <= length)
        ends = [k for k in range(len(place)) if place[k] >= n - length]
        best = min(cost[k] + place[k] for k in ends)
        total, before = 0, 0
        for c in cuts:
            total += length - (c - before) + penalty[place.index(c)]
            before = c
        assert total + before == best
