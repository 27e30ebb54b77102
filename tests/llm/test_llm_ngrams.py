"""Elias-Fano sequences and tries against plain arrays; scores against a plain
bigram model."""

import math
import mmap
from collections import Counter

import numpy as np
from llm_cases import awkward, empty, sample
from pyspark.sql import functions as F
from tessera.llm import ngram_model as N
from tessera.llm.elias_fano import EliasFano, Trie, quantise


def test_sequences():
    rng = np.random.default_rng(0)
    cases = [np.sort(rng.integers(0, top, n, dtype=np.uint64)) for top in (3, 50, 10_000, 2 ** 63, 2 ** 64 - 1) for n in (1, 7, 900)]
    cases += [np.zeros(5, np.uint64), np.array([], np.uint64), np.array([0, 0, 2 ** 64 - 1], np.uint64)]
    for v in cases:
        e = EliasFano(v)
        flat = np.concatenate(e.parts()).astype(np.uint64)
        again, at = EliasFano.read(np.concatenate([np.zeros(3, np.uint64), flat]), 3)
        assert at == len(flat) + 3
        for s in (e, again):
            assert (s.get(np.arange(len(v))) == v).all()
            ask = np.concatenate([v, v + np.uint64(1), rng.integers(0, 2 ** 64 - 1, 50, dtype=np.uint64), np.array([0], np.uint64)])
            assert (s.successor(ask) == np.searchsorted(v, ask)).all()


def test_searches_within_ranges():
    r = np.random.default_rng(5)
    v = np.unique(r.integers(0, 40_000, 3000)).astype(np.uint64)
    s = EliasFano(v)
    ask = np.r_[r.choice(v, 2000), r.integers(0, 60_000, 2000).astype(np.uint64)]
    begin = r.integers(0, len(v), len(ask))
    end = np.minimum(begin + r.integers(0, 200, len(ask)), len(v))
    want = np.array([b + np.searchsorted(v[b:e], x) for x, b, e in zip(ask, begin, end, strict=True)])
    assert (s.successor(ask, (begin, end)) == want).all()
    i, there = s.find(ask, (begin, end))
    assert (i == want).all() and there.tolist() == [x in v[b:e] for x, b, e in zip(ask, begin, end, strict=True)]
    assert there.any() and not there.all()


def test_sequences_are_compact():
    v = np.sort(np.random.default_rng(1).choice(10_000_000, 100_000, replace=False)).astype(np.uint64)
    e = EliasFano(v)
    assert sum(p.nbytes for p in e.parts()) * 8 / len(v) < 2.6 + math.log2(100)


def test_trie_answers_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 4000), rng.integers(0, 2 ** 63, 4000) % 500 * 2 ** 40, strict=True)})
    c, w = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    p = -rng.random(len(c)) * 5
    roots, n = np.unique(c, return_counts=True)
    t = Trie.build(c, w, p, roots, n * 3)
    (tmp_path / "t").write_bytes(t.tobytes())
    with open(tmp_path / "t", "rb") as f:
        t = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        parent, count = t.contexts(np.concatenate([c, [np.uint64(999)]]))
        assert parent[-1] == -1 and count[-1] == 0 and (count[:-1] == np.repeat(n * 3, n)).all()
        got = t.log_p(parent[:-1], t.words(w))
        assert np.abs(got - p).max() < 0.002 and abs(got.mean() - p.mean()) < 1e-9
        assert np.isnan(t.log_p(parent[:-1], t.words(w + np.uint64(1)))).all()
        begin, end = t.spans(np.r_[np.arange(len(roots)), -1])  # the pointers delimit each context's children
        assert (end[:-1] - begin[:-1]).tolist() == np.unique(c, return_counts=True)[1].tolist() and begin[-1] == end[-1]


def test_quantised_values_keep_their_sum():
    x = np.random.default_rng(3).normal(size=5000)
    code, book = quantise(x)
    assert len(book) <= 4096 and abs(book[code].sum() - x.sum()) < 1e-6 and np.abs(book[code] - x).max() <= np.ptp(x) / 4095


def plain(rows, train, top, mu):
    token = {j: (t or "").encode().lower().split() for j, (i, t, *_) in enumerate(rows)}
    uni, pair, ctx, texts = Counter(), Counter(), Counter(), 0
    for j in train:
        uni.update(token[j])
        texts += 1
        s = ["<"] + token[j] + [">"]
        pair.update(zip(s, s[1:], strict=False))
    ctx = Counter(uni)
    ctx["<"] = texts
    total, types = sum(uni.values()) + texts, len(uni) + (texts > 0)
    octave = lambda n: math.floor(8 * math.log2(n))
    at_least = {o: [w for w in uni if octave(uni[w]) >= o] for o in {octave(n) for n in uni.values()}}
    best = {w: uni[w] for w in max((v for v in at_least.values() if len(v) <= top), key=len, default=[])}
    z = total + 0.5 * (len(best) + 2)
    rest = total - texts - sum(best.values())
    def p1(w):
        if w == ">":
            return (texts + 0.5) / z
        return (best[w] + 0.5) / z if w in best else (rest + 0.5) / z / (types - 1 - len(best) + 1)
    out = []
    for j, (i, *_) in enumerate(rows):
        w = token[j]
        base = sum(math.log10(uni[x] + 0.5) for x in w) + math.log10(texts + 0.5) - (len(w) + 1) * math.log10(total + 0.5 * (types + 1))
        s = ["<"] + w + [">"]
        score = sum(math.log10((pair[a, b] + mu * p1(b)) / (ctx[a] + mu)) for a, b in zip(s, s[1:], strict=False))
        out.append((i, len(w) + 1, sum(x in uni for x in w) + (texts > 0), total, base, score))
    return sorted(out, key=repr)


def check(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) <= 1e-7 * max(1, abs(w[4])), (g, w)
        assert abs(g[5] - w[5]) <= 0.003 * w[1], (g, w)


def test_scores(spark):
    rows, d = awkward(spark, sample())
    train = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))
    member = [j for j, r in enumerate(rows) if r[0] is None or r[0] % 4 != 1]
    for kw in ({}, {"top_words": 40, "mu": 3.0}, {"pairs_per_shard": 3000, "mu": 3.0}, {"top_words": 0}):
        m = N.NgramModel(d, train, **kw)
        got = sorted((tuple(r) for r in m.score().select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
        check(got, plain(rows, member, kw.get("top_words", 60_000), kw.get("mu", m.mu)))
        if "pairs_per_shard" in kw:
            assert m.shards > 20 and m.parts.max() > 1


def test_words_beyond_the_coded_ones_have_probabilities_of_their_own(spark):
    """More types of equal count than there are codes: words of count two and of one must not score alike."""
    from llm_cases import frame
    rng = np.random.default_rng(6)
    once, twice = ([f"{c}{i}" for i in range(61_000)] for c in "ab")
    bag = rng.permutation(once + 2 * twice)
    rows = [(i, " ".join(x), "en", "s", 1) for i, x in enumerate(np.array_split(bag, 100))]
    rows += [(1000 + i, " ".join(rng.choice(words, 300)), "en", "s", 1) for i, words in enumerate((once, twice, once, twice))]
    for rows, kw in ((rows, {}), (sample(), {"code_words": 40, "mu": 3.0, "pairs_per_shard": 3000})):  # noqa: B020
        m = N.NgramModel(frame(spark, rows), F.col("doc_id") < 1000, **kw)
        got = sorted((tuple(r) for r in m.score().select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
        check(got, plain(rows, [j for j, r in enumerate(rows) if r[0] < 1000], 1 << 40, m.mu))
        assert len(m.unigrams.words) < m.unigrams.types - 1


def test_the_model_can_be_kept(spark):
    rows, d = awkward(spark, sample(80))
    m = N.NgramModel(d, F.lit(True), pairs_per_shard=20_000)
    tries = m.tries().collect()
    t = [Trie(bytes(r.trie)) for r in tries]
    assert len(t) > 1 and sum(r.pairs for r in tries) == sum(len(x.code) for x in t) > 1000


def test_no_training_rows_and_empty_tables(spark):
    rows, d = awkward(spark, sample(20))
    out = N.NgramModel(d, F.lit(False)).score().collect()
    assert len(out) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 for r in out)
    assert N.NgramModel(empty(spark), F.lit(True)).score().count() == 0
