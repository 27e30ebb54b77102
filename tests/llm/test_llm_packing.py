"""Packing: exact round trip, powers of two, ids by the tokenizer file."""

import zlib

import numpy as np
from llm_cases import awkward, empty, frame, sample
from tessera.llm import packing as P
from tessera.llm.queries import vocabulary


def ids_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_cut():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        p = P.cut(n, 1024)
        assert [s for s, _ in p] == [sum(k for _, k in p[:i]) for i in range(len(p))] and sum(k for _, k in p) == n
        assert all(k & (k - 1) == 0 and k <= 1024 for _, k in p) and len(p) <= n // 1024 + 10


def test_round_trip(spark):
    rows, d = awkward(spark, [*sample(), (40_000, "<|endoftext|> a　b\r\n  c<|endoftext|><|endoftext|>x <|endoftext", "en", "x", 1)])
    got = P.pack_power_of_two(d, vocabulary()).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    whole = {}
    for r in got:
        a = np.array(r.ids, "<u4")
        assert len(a) == r.length and zlib.crc32(a.tobytes()) == r.ids_crc32 and 1 << r.bucket == r.length
        whole.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    want = {}
    for (i, *_), ids in zip(rows, ids_of([r[1] for r in rows]), strict=True):
        want.setdefault(i, []).append(ids)
    for i, docs in want.items():
        if len(docs) == 1:  # the others are mixed under one id
            parts = sorted(whole[i])
            assert [x for _, ids, _ in parts for x in ids] == docs[0]
            assert {n for *_, n in parts} == {len(docs[0])}
    assert sum(r.length for r in got) == sum(len(x) for d in want.values() for x in d)
    assert P.pack_power_of_two(empty(spark), vocabulary()).count() == 0


def test_sequence_ids_do_not_change_between_runs(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = P.pack_power_of_two(d, vocabulary(), with_ids=False)
    assert a.exceptAll(P.pack_power_of_two(d, vocabulary(), with_ids=False)).count() == 0


def test_buckets_on_disk(spark, tmp_path):
    P.write_buckets(P.pack_power_of_two(frame(spark, sample(20)), vocabulary()), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("size(ids) <> shiftleft(1, bucket)").count() == 0
