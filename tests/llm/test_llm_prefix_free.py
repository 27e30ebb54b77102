"""Removal of repeats against a count of every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, empty, frame, sample
from tessera.llm import prefix_free as P


def plain(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[x:x + length] for _, b in data for x in range(len(b) - length + 1))
    out = []
    for i, b in data:
        mark = np.zeros(len(b) + 1, np.int64)
        for x in range(len(b) - length + 1):
            if seen[b[x:x + length]] > 1:
                mark[x] += 1
                mark[x + length] -= 1
        gone = np.cumsum(mark)[:len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    rows, d = awkward(spark, sample())
    want = plain(rows, 400)
    assert got(P.remove_repeats(d)) == want and sum(w[2] > 0 for w in want) > 5
    assert P.remove_repeats(empty(spark)).count() == 0


def test_planted_passages_at_other_lengths(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = noise(300)
    rows = [(i, noise(200) + passage[rng.randint(0, 60):rng.randint(200, 300)] + noise(150), "en", "x", 1) for i in range(40)]
    rows += [(100 + i, "ab" * 200 + noise(30) + "a" * 500, "en", "x", 1) for i in range(3)]
    rows += [(200, noise(90), "en", "x", 1), (201, passage + passage, "en", "x", 1)]
    for length, reach in ((100, 40), (80, 16), (64, 32)):
        assert got(P.remove_repeats(frame(spark, rows), length=length, reach=reach)) == plain(rows, length)
    with pytest.raises(ValueError):
        P.remove_repeats(frame(spark, rows), length=40, reach=30)


def test_long_texts_are_parsed_in_segments(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 700)
    rows = sample(60)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20_000]
    assert got(P.remove_repeats(frame(spark, rows, 2), length=200, reach=64)) == plain(rows, 200)


def test_rolling_hash_and_minimum():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    data[300:340] = data[100:140]
    r = P.Rolling(data.astype(np.uint64))
    h = r.of(np.arange(460), 40)
    assert h[300] == h[100] and len(np.unique(h)) == 459
    x = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    for w in (1, 7, 64, 200):
        assert (P.sliding_min(x, w) == np.array([x[i:i + w].min() for i in range(200 - w + 1)])).all()


def shared(rows, words):
    from llm_cases import WORD
    data = [((i, t or ""), WORD.findall(t or "")) for i, t, *_ in rows]
    holders = {}
    for key, w in data:
        for x in range(len(w) - words + 1):
            holders.setdefault(tuple(w[x:x + words]), set()).add(key)
    out = set()
    for (i, t), w in data:
        hit = {y for x in range(len(w) - words + 1) if len(holders[tuple(w[x:x + words])]) > 1 for y in range(x, x + words)}
        if hit:
            out.add((str(i), len(t), len(hit)))
    return out


def test_shared_words(spark, monkeypatch):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(("to", "the", "é", "a,")) + str(rng.randrange(500)) for _ in range(n))
    passage = noise(80).split(" ")
    rows = [(500 + k, noise(30) + "\n" + rng.choice((" ", "\t \n")).join(passage[k % 9:k % 9 + n]) + " " + noise(20), "en", "x", 1)
            for k, n in enumerate([49, 50, 51, 52, 60, 70, 51, 51])]
    rows += [(600, noise(60) + " again " + noise(1), "en", "x", 1), (601, " ".join(["ha"] * 200), "en", "x", 1)]
    rows, d = awkward(spark, [*sample(), *rows])
    lengths = d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).distinct()
    for words, reach in ((51, 32), (20, 12)):
        got = P.shared_words(d, words=words, reach=reach).withColumnRenamed("doc_id", "i")
        got = got.join(lengths, got["i"].eqNullSafe(lengths["doc_id"]) & (got["rk"] == lengths["h"]))
        got = [(str(r.i), r.n, r.n_shared_words) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == shared(rows, words)
    assert P.shared_words(empty(spark)).count() == 0
