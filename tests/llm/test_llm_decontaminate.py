"""Decontamination against a search of every window in every document."""

import re

import pytest
from llm_cases import awkward, empty, lower, sample
from tessera.llm import decontaminate as D

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(rows, items, size=10):
    wins = {}
    for i, t in items:
        w = W.findall(lower(t))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(None if i is None else str(i))
    out = []
    for i, t, *_ in rows:
        w = W.findall(lower(t))
        hit, ids = set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                got = wins.get(tuple(w[s:s + k]))
                if got:
                    hit |= set(range(s, s + k))
                    ids |= got
        out.append((i, len(w), len(hit), tuple(sorted(x for x in ids if x is not None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_hits(spark, monkeypatch, limit):
    """Both ways: the prefix table broadcast, and shuffled."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    rows, d = awkward(spark, sample())
    text = next(t for _, t, *_ in rows if t and len(W.findall(t)) > 60)
    w = W.findall(text)
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[20:27])), (3, "w5 Zeta982"), (4, "absent " * 12), (5, ""), (6, None),
             (7, " ".join(w[5:30]).upper()), (None, " ".join(w[40:52])), (8, "ha " * 11), (9, "ünï cödé"), (11, w[3])]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in D.decontaminate(d, items_df).collect()), key=repr)
    want = plain(rows, items)
    assert got == want and sum(x[2] > 0 for x in want) > 4


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert D.decontaminate(empty(spark), items).count() == 0
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    r = D.digest(D.decontaminate(d, items.limit(0))).collect()
    assert len(r) == 1 and r[0].n_hit == 0 and not r[0].contaminated and r[0].n_words == 3
