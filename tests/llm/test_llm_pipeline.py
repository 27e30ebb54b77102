"""The pipeline stage by stage against plain Python on a small corpus."""

import re

from llm_cases import frame, lower
from test_llm_decontaminate import plain as windows_hit
from test_llm_line_runs import plain as lines_plain
from test_llm_quality_rules import plain as measures
from test_llm_simhash import plain_components, plain_fp

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_names_and_order():
    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    assert C.ORACLE_SQL is None


def test_every_stage_works_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    for name, step in C.STAGES:
        out = step(spark, frame(spark, rows), SF)
        if name == "packing":
            break
        assert out.columns == docs.columns
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        if name == "quality rules":  # too few labels here for any cutoff
            want = [r for r in rows if not measures(r[1])[5]]
        elif name == "line dedup":
            text = {i: t for i, _, n, t in lines_plain(rows) if n}
            want = [(i, text.get(i, t), a, s, len(text[i]) if i in text else n) for i, t, a, s, n in rows]
        elif name.startswith("simhash"):
            comp = plain_components([plain_fp(r[1]) for r in rows], 4)
            least = {}
            for r in rows:
                c = comp[plain_fp(r[1])]
                least[c] = min(r[0], least.get(c, r[0]))
            want = [r for r in rows if least[comp[plain_fp(r[1])]] == r[0]]
        else:
            hit = {i for i, _, n, _ in windows_hit(rows, items) if n}
            want = [r for r in rows if r[0] not in hit]
            assert hit
        assert got == sorted(want, key=repr), name
        assert len(got) > 100
        rows = got
    whole = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(whole) == len(rows) and all(r[1] == r[2] for r in whole)


def test_run(spark):
    a = C.run(spark, SF)
    assert a.count() == a.select("sequence_id").distinct().count() > 100
    assert re.match("doc_id", ",".join(a.columns)) and lower("A") == "a"


def test_the_last_stage_returns_the_token_ids(spark):
    import zlib

    import numpy as np
    out = C.packing_stage(spark, frame(spark, [(1, "some words to pack", "en", "s", 18), (None, None, None, None, None)]), SF).collect()
    assert {r.doc_id for r in out} == {1, None}
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)


def test_every_stage_takes_awkward_rows_and_names(spark):
    """Null and repeated ids, repeated rows, columns named like the stages' own,
    dotted and differing in case only; and empty tables."""
    from llm_cases import awkward, empty, sample
    from pyspark.sql import functions as F
    rows, d = awkward(spark, sample(40))
    for c in ("_lines", "_row", "_out", "_row_rk", "_id", "_key", "_kept", "_rk", "_hit", "c0", "a.b", "N_LINES", "component", "bucket"):
        d = d.withColumn(c, F.lit("keep " + c))
    d = d.drop("n_chars")  # a stage needs no more than id and text
    d = spark.createDataFrame(d.collect(), d.schema).repartition(3)
    ids = sorted(str(r[0]) for r in rows)
    for name, step in C.STAGES[:-1]:
        out = step(spark, d, SF)
        assert out.columns == d.columns, name
        got = out.collect()
        assert all(r[c] == "keep " + c for r in got for c in ("_lines", "_row_rk", "a.b", "N_LINES", "c0")), name
        left = sorted(str(r["doc_id"]) for r in got)
        if name == "line dedup":
            assert left == ids
        else:
            assert 0 < len(left) <= len(ids) and set(left) <= set(ids), name
        if name == "simhash near-dedup":
            assert len({(r["doc_id"], r["text"] or "") for r in got}) == len(got)
        nothing = step(spark, empty(spark), SF)
        assert nothing.count() == 0 and nothing.columns == empty(spark).columns
    packed = C.packing_stage(spark, d, SF)
    assert packed.where("start = 0").count() == len(rows)
    assert C.packing_stage(spark, empty(spark), SF).count() == 0
