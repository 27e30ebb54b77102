"""Measures against plain counts, cutoffs against exact binomial sums."""

import math

from llm_cases import WORD, awkward, empty, sample
from pyspark.sql import functions as F
from tessera.llm import quality_rules as Q


def plain(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    hit = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(8)}
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), base)


def test_measures(spark):
    rows, d = awkward(spark, sample())
    m = Q.measures(d.select("doc_id", "text", "lang"))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in m.collect()), key=repr)
    want = sorted(((i, *plain(t)) for i, t, *_ in rows), key=repr)
    assert got == want and sum(w[5] > 0 for w in want) > 3 and sum(w[4] > 0 for w in want) > 1


def tail(k, n, p):
    lg = math.lgamma
    return math.fsum(math.exp(lg(n + 1) - lg(j + 1) - lg(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
                     for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 1), (0, 500), (1, 1000), (3, 4000), (9, 4000), (0, 100_000), (150, 100_000)]
    d = spark.createDataFrame(cases, "k long, n long")
    for p in (0.002, 0.05):
        got = {(r.k, r.n): r.p for r in d.select("k", "n", Q.binomial_lower_tail(F.col("k"), F.col("n"), p).alias("p")).collect()}
        for k, n in cases:
            want = 1.0 if k >= n * p else tail(k, n, p)
            assert abs(got[(k, n)] - want) <= 1e-7 * want + 1e-300, (k, n, p)


def test_cutoffs_are_the_strictest_that_the_test_allows(spark):
    """Brute force over a made-up holdout: certified levels, none for a stratum
    that is too small, and no stricter cutoff would have passed."""
    rules = (Q.Rule("a", "x", (5.0, 4.0, 3.0, 2.0, 1.0)), Q.Rule("b", "x", (0.5, 1.5, 2.5), above=False))
    rows = [("en", (i * 37 % 1000) / 200.0) for i in range(4000)] + [("de", 2.0)] * 30 + [(None, 3.5)] * 900
    good = spark.createDataFrame(rows, "lang string, x double").repartition(4)
    got = {(r.stratum, r.rule): (r.n, r.k, r.cutoff) for r in Q.certified_cutoffs(good, "lang", rules, 0.5, 0.05).collect()}
    want = {}
    for s in ("en", "de", None):
        v = [x for t, x in rows if t == s]
        for rule in rules:
            for c in rule.cutoffs:
                k = sum((x > c) if rule.above else (x < c) for x in v)
                if k < len(v) * 0.25 and tail(k, len(v), 0.25) <= 0.05 / 6:
                    want[(s, rule.name)] = (len(v), k, c)
    assert got == want and (None, "a") in want and want[("en", "a")][2] < 5


def test_good_documents_stay_and_bad_ones_go(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w#$%&{i}" for i in range(60))
    rows = [(i, good + f" extra{i}", "en", "s", 1) for i in range(3000)] + [(5000 + i, bad + f" extra{i}", "en", "s", 1) for i in range(300)]
    from llm_cases import frame
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 5000), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    out = Q.quality_rules(d, labels, max_false_rejection=0.05)
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert kept == set(range(3000))
    assert Q.quality_rules(empty(spark), labels).count() == 0
    none = Q.quality_rules(d, labels.limit(0))
    assert none.where("kept").count() == len(rows)


def test_awkward_rows(spark):
    rows, d = awkward(spark, sample(40))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = Q.quality_rules(d, labels)
    assert out.count() == len(rows) and out.where("kept IS NULL").count() == 0
