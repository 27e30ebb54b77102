"""The lookup table against a plain fill; placement against the table."""

import hashlib

import pytest
from llm_cases import awkward, empty, sample
from tessera.llm import placement as P


def plain(names, size):
    names = sorted(names)
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        o, k = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        orders.append([(o + i * k) % size for i in range(size)])
    table, at, turn = {}, [0] * len(names), 0
    while len(table) < size:
        who = turn % len(names)
        while orders[who][at[who]] in table:
            at[who] += 1
        table[orders[who][at[who]]] = who
        turn += 1
    return [table[i] for i in range(size)]


def test_table_is_filled_by_turns():
    names = P.shard_names(7)
    t = P.fill_table(names, 211)
    assert t.tolist() == plain(names, 211) == P.fill_table(names[::-1], 211).tolist()
    n = [(t == i).sum() for i in range(7)]
    assert max(n) - min(n) <= 1


def test_weights_and_wrong_sizes():
    t = P.fill_table({"a": 3, "b": 1}, 1009)
    assert abs((t == 0).sum() - 3 * (t == 1).sum()) <= 4
    for bad in (lambda: P.fill_table(["a"], 1000), lambda: P.fill_table([], 13), lambda: P.fill_table({"a": 0}, 13)):
        with pytest.raises(ValueError):
            bad()


def test_few_slots_move_when_a_shard_leaves():
    names = P.shard_names(64)
    gone = P.moved(names, [n for n in names if n != "shard-031"], P.SIZE)
    assert 1 / 64 - 0.001 < gone < 0.06


def test_placement(spark, tmp_path):
    rows, d = awkward(spark, sample(60))
    names = P.shard_names(5)
    out = P.place(d, ["doc_id"], names, 211)
    table = P.fill_table(names, 211)
    got = out.select("doc_id", "slot", "shard", "_slot").collect()
    assert len(got) == len(rows) and all(r.shard == names[table[r.slot]] and r._slot == "x" for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert P.place(empty(spark), ["doc_id"], names).count() == 0
    P.write_shards(out.select("doc_id", "slot", "shard"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
