"""Line dedup against a plain count of keys."""

from collections import defaultdict

from llm_cases import awkward, empty, frame, lower, sample
from tessera.llm.line_runs import LineRuns, keyed_lines, line_dedup, merge, without


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_chars=20, min_docs=3):
    rank = lambda i: -(2 ** 63) if i is None else i
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(rank(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        gone = [len(held.get(key(x), ())) >= min_docs and rank(i) != max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_same_lines_go_for_any_batches_and_fanout(spark):
    rows = sample()
    rows += [(20_000 + i, "a line that many documents share\nown %d" % i, "en", "x", 1) for i in range(40)]
    want = plain(rows)
    assert sum(r[2] for r in want) > 40
    for batches, fanout in ((1, 2), (4, 2), (5, 3)):
        assert got(line_dedup(frame(spark, rows), batches=batches, fanout=fanout)) == want


def test_awkward_rows_columns_and_empty_table(spark):
    rows, d = awkward(spark, sample(60))
    out = line_dedup(d)
    assert got(out) == plain(rows)
    assert {c for c in d.columns if c != "kept_text"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert out.where("_row = 'x' AND pos = 'x'").count() == len(rows)
    assert line_dedup(empty(spark)).count() == 0


def test_runs_are_levelled_and_fresh_keys_are_known(spark):
    rows = [(i, f"shared by all of the documents\nonly in document number {i}", "en", "x", 1) for i in range(60)]
    lines = keyed_lines(frame(spark, rows), "doc_id", "text", 20, 4).cache()
    runs = LineRuns(fanout=2)
    sizes, fresh = [], 0
    for b in range(4):
        run = runs.add(lines.where(f"batch = {b}"))
        fresh += run.where("fresh").count()
        sizes.append(len(runs.runs()))
    assert sizes == [1, 1, 2, 1] and fresh == 61
    r = runs.repeated(3).collect()
    assert len(r) == 1 and r[0].n_docs == 60 and r[0].max_id == 59 and not r[0].fresh
    lines.unpersist()


def test_anti_joins_and_compactions_move_no_row(spark):
    rows = [(i, f"shared by {i % 7} of the documents\nonly in document number {i}", "en", "x", 1) for i in range(90)]
    lines = keyed_lines(frame(spark, rows), "doc_id", "text", 20, 3).cache()
    runs = LineRuns(fanout=3, buckets=4)
    added = [runs.add(lines.where(f"batch = {b}")).drop("fresh") for b in range(2)]
    batch, own = runs.raised[0]
    for df in (without(batch, added[:1]), without(batch, [own]), merge(added)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "BucketedScan" in plan.replace("Bucketed: true", "BucketedScan")
    # every key lies in one run, and repeats hold what the anti-join left out
    keys = added[0].select("h1", "h2").unionAll(added[1].select("h1", "h2"))
    assert keys.count() == keys.distinct().count()
    assert without(batch, [own]).count() == batch.count() - own.count() > 0
    lines.unpersist()


def test_a_line_that_fills_one_document_is_hot(spark):
    rows = [(1, "\n".join(["the very same line of text again"] * 500), "en", "x", 1)]
    rows += [(i, f"the very same line of text again\nown line of the document {i}", "en", "x", 1) for i in range(2, 6)]
    assert got(line_dedup(frame(spark, rows))) == plain(rows)
