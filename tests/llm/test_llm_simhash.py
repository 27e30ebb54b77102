"""Fingerprints and components against brute force."""

import numpy as np
import xxhash
from llm_cases import awkward, empty, frame, sample, words
from pyspark.sql import functions as F
from tessera.llm import simhash_dedup as S
from tessera.llm.components import connected_components
from tessera.llm.gray_index import GrayIndex, gray_rank


def plain_fp(t, k=4):
    w = words(t)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    ones = [0] * 64
    for x in sh:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def plain_components(codes, radius):
    """{code: smallest linked code} over distinct codes."""
    v = np.array(sorted(set(codes)), np.uint64)
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {int(c): int(v[find(i)]) for i, c in enumerate(v)}


def test_awkward_rows(spark):
    rows, d = awkward(spark, sample())
    out = S.simhash_dedup(d)
    fps = [(i, plain_fp(t)) for i, t, *_ in rows]
    comp = plain_components([f for _, f in fps], 4)
    least = {}
    for i, f in fps:
        i = -(2 ** 63) if i is None else i
        least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i, f, None if least[comp[f]] == -(2 ** 63) else least[comp[f]]) for i, f in fps), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out.collect()), key=repr)
    assert got == want
    assert {r.fingerprint for r in S.digest(out).collect()} == {f"{f:016x}" for _, f in fps}
    assert S.simhash_dedup(empty(spark)).count() == 0


def _codes(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for b in rng.integers(0, 1 << 64, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 30)):
            c = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                c ^= 1 << int(k)
            out.append(c)
    return np.unique(np.array(out, np.uint64))


def test_index_finds_all_pairs_of_a_group():
    codes = _codes(40)
    group = np.random.default_rng(1).integers(0, 3, len(codes))
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    index = GrayIndex(codes, group, leaf=4, fanout=3)
    got = {p for i, j in index.pairs(np.arange(len(codes)), 4) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert got == want and len(want) > 50
    assert len(index.levels) > 2


def test_gray_rank_is_the_place_in_the_gray_sequence():
    place = np.arange(1 << 12, dtype=np.uint64)
    assert (gray_rank(place ^ (place >> np.uint64(1))) == place).all()


def test_hot_groups_are_split_without_losing_a_link(spark):
    """A tiny group limit forces several rounds of splitting."""
    codes = _codes(30, 5)
    df = spark.createDataFrame([(int(c) - (1 << 64) if c >> np.uint64(63) else int(c),) for c in codes], "fp long").repartition(4)
    want = plain_components(codes.tolist(), 4)
    for limit in (3, 40, 20_000):
        named = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(S.links(df, 4, limit)).collect()}
        groups = {}
        for c in want:
            groups.setdefault(want[c], set()).add(named.get(c, c))
        assert all(len(g) == 1 for g in groups.values())
        assert len({named.get(c, c) for c in want}) == len(groups)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    import corpus_pipeline
    rows = sample()
    out = corpus_pipeline.near_stage(spark, frame(spark, rows), "")
    comp = S.simhash_dedup(frame(spark, rows))
    assert out.count() == comp.select("component_id").distinct().count()
    assert {r.doc_id for r in out.collect()} == {r.component_id for r in comp.select(F.col("component_id")).collect()}


def test_null_and_reused_ids_keep_a_row_of_each_group(spark):
    import corpus_pipeline
    rows = sample()
    apart = ["".join(f"{c}{i}{c} " for i in range(60)) for c in "qwz"]
    rows += [(None, t, None, None, None) for t in (*apart, rows[3][1], "")] + [(7_777, a.replace("1", "ö"), "en", "odd", None) for a in apart]
    rows, d = awkward(spark, rows)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, d, "").collect()]
    comp = plain_components([plain_fp(t) for _, t, *_ in rows], 4)
    least = {}
    for i, t, *_ in rows:
        least.setdefault(comp[plain_fp(t)], set()).add(-(2 ** 63) if i is None else i)
    got = {comp[plain_fp(t)]: -(2 ** 63) if i is None else i for i, t in out}
    assert len(out) == len(got) and got == {c: min(ids) for c, ids in least.items()}
    assert sum(i is None for i, _ in out) >= 5 and sum(i == 7_777 for i, _ in out) == 3
