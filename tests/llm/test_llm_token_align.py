"""Token alignment against whole-text tokenisation and plain loops."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, empty, frame, sample

from tessera.llm import token_align as TA
from tessera.llm.queries import tokenizer_file, vocabulary

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    """(ids and byte lengths by A, by B) of a whole text, by the plain libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    assert ByteLevel is not None

    def a(text):
        ids = t.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(back[c] for c in t.id_to_token(i)) for i in ids]

    def b(text):
        ids = sp.encode(text)
        return ids, [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                     else sp.id_to_piece(i).replace("\u2581", " ").encode() for i in ids]
    return a, b


def groups_of(text, tools):
    if not text:
        return []
    (a, xa), (b, xb) = tools[0](text), tools[1](text)
    whole = (" " + text).encode()
    if b"".join(xa) != whole or b"".join(xb) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def plain(rows, tools):
    groups = [groups_of(r[1], tools) for r in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = collections.Counter(p for d in links for p in d)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for r, g, d in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((str(r[0]), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(d.values()),
                    sum(n for p, n in d.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in d.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else "", text))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups)
                  for r in df.collect())


ODD = ["<|endoftext|> a \u2581 b", "a  b   c ", "  lead", " ", "   ", "\n\n  x\n y", "tab\tand\u3000wide", "\u65e5\u672c\u8a9e\U0001f600 ok",
       "x" * 5000, "don't we'll 12345 6.78", "a\u0301 \ufb01 \u2126", "trail \n "]


def test_against_whole_text_version(spark, tools):
    rows, d = awkward(spark, [*sample(60), *[(90_000 + i, t, None, None, None) for i, t in enumerate(ODD)]])
    assert got(TA.align(d, vocabulary(), MODEL, chunk_bytes=30_000, with_groups=True)) == plain(rows, tools)


def test_chunks_and_partitions_do_not_matter(spark):
    rows = sample(40)
    a = TA.align(frame(spark, rows, 1), vocabulary(), MODEL).collect()
    b = TA.align(frame(spark, rows, 4), vocabulary(), MODEL, chunk_bytes=5_000).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_empty_table(spark):
    assert TA.align(empty(spark), vocabulary(), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab zQ .,<|\n\t'9\u00e9\u65e5\U0001f600\u2581", min_size=1, max_size=40))
def test_units_are_coded_like_the_whole(tools, text):
    units = TA.units_of(text)
    b = TA.Pieces(MODEL)
    whole, coded = tools[1](text), [i for ids in b.encode(units) for i in ids]
    if b"".join(whole[1]) == (" " + text).encode():
        assert coded == whole[0]
    else:
        assert b"".join(b.bytes[i] for i in coded) != (" " + text).encode()
    from tessera.llm.packing import encoder
    assert [i for u in units for i in encoder(vocabulary())(u).tolist()] == tools[0](text)[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.integers(0, 99)), min_size=1, max_size=4))
def test_terminal_tokens(parts):
    a, b = [], []
    for sizes, seed in parts:  # the same bytes, cut another way
        a += sizes
        rng, left = np.random.default_rng(seed), sum(sizes)
        while left:
            b.append(min(left, int(rng.integers(1, 5))))
            left -= b[-1]
    a, b = np.cumsum(a), np.cumsum(b)
    ends = sorted(set(a.tolist()) & set(b.tolist()))
    x, y = TA.terminal(a, b)
    assert x.tolist() == np.searchsorted(ends, a).tolist() and y.tolist() == np.searchsorted(ends, b).tolist()


def test_large_groups_are_expanded_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 7, 50)
    size = np.array([30, 30]), np.array([20, 30])
    want = TA.Units._pairs(a, b, *size, np.array([0, 1]), 2)
    monkeypatch.setattr(TA, "BLOCK", 10)
    for x, y in zip(TA.Units._pairs(a, b, *size, np.array([0, 1]), 2), want, strict=True):
        assert x.tolist() == y.tolist()
