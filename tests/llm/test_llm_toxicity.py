"""Toxicity: held-out accuracy, awkward rows, labels that cannot teach."""

import numpy as np
from llm_cases import awkward, empty, frame, sample
from tessera.llm import toxicity as T


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_windows_hold_the_whole_text():
    t = "Äa BB\x0bcc  dd\n" * 99
    assert b"".join(T.windows(t, 20)).split() == t.encode().lower().split()
    assert T.windows(" \n", 20) == [] and T.windows("", 20) == []


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rng = np.random.default_rng(3)
    base = [r for r in d.join(labels, "doc_id").where("quality = 1 AND toxic = 0").select("doc_id", "text").collect()]
    bad = ["moronic", "scumbag", "wretched", "vermin", "lowlife"]
    rows, known = [], []
    for k in range(4):
        for r in base:
            i, toxic = r.doc_id + 10_000 * k, int(rng.random() < 0.3)
            w = r.text.split()
            if toxic:
                for at in rng.integers(0, len(w), max(2, len(w) // 15)):
                    w.insert(int(at), bad[rng.integers(5)])
            rows.append((i, " ".join(w), "en", "s", 1))
            known.append((i, 1, toxic))
    learn = [x for x in known if x[0] % 5]
    model = T.train(frame(spark, rows), spark.createDataFrame(learn, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in T.score(frame(spark, rows), model).collect()}
    held = [x for x in known if x[0] % 5 == 0]
    y, s = np.array([x[2] for x in held]), np.array([out[x[0]].score for x in held])
    assert auc(y, s) > 0.95
    assert np.mean([out[x[0]].predicted == x[2] for x in held]) > 0.9
    assert all(0 <= v <= 1 for v in s) and all(out[i].predicted == (out[i].score >= 0.5) for i in out)


def test_awkward_rows_and_missing_classes(spark):
    rows, d = awkward(spark, sample(60))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(0, 1, None), (None, 1, 1), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 0"), labels.limit(0)):
        out = T.score(d, T.train(d, known)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert T.score(empty(spark), T.train(empty(spark), labels)).count() == 0


def test_every_leaning_word_counts(spark):
    """A lexicon of several times the least dictionary: each of its words is evidence."""
    rng = np.random.default_rng(9)
    make = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(n)]
    plain, bad = make(3000), make(700)
    rows, known = [], []
    for i in range(1600):
        toxic = i % 2
        words = list(rng.choice(plain, 100)) + list(rng.choice(bad, 70, replace=False)) * toxic
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 1))
        known.append((i, 1, toxic))
    model = T.train(frame(spark, rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), min_docs=5)
    held = model.toxic.decode("latin-1")
    assert np.mean([w in held for w in bad]) > 0.95
    probe = [(i, " ".join(rng.permutation([*rng.choice(plain, 30), *bad[i * 7:i * 7 + 7]])), "en", "s", 1) for i in range(100)]
    clean = [(1000 + i, " ".join(rng.choice(plain, 37)), "en", "s", 1) for i in range(100)]
    out = {r.doc_id: r.score for r in T.score(frame(spark, probe + clean), model).collect()}
    y = np.array([r[0] < 1000 for r in probe + clean], int)
    assert auc(y, np.array([out[r[0]] for r in probe + clean])) > 0.97
