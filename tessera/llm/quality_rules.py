"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when a measured value lies beyond a cutoff.  The
cutoff is not guessed: for every stratum (a column such as the language) and
every rule, the labelled good documents are a holdout, and a cutoff may be used
only when an exact binomial test shows that it falsely rejects at most the
rule's share of ``max_false_rejection``.  The test of one cutoff is
``P(Bin(n, risk) <= k) <= delta / (strata * rules)`` (n good documents, k of
them rejected), which is the Clopper-Pearson upper bound in p-value form with
Bonferroni over strata and rules.  Within a rule the cutoffs run from lenient
to strict; k only grows along them, so the strictest cutoff that passes equals
fixed-sequence testing and needs no further correction.  Summed over the rules,
good documents of a stratum are falsely rejected with probability at most
``max_false_rejection``, all statements together holding with confidence
``1 - delta``.  A stratum with too few labels gets no cutoff and rejects none.

All work is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_RUN, SPACES, covered, row_key, split_words, stage, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``value`` beyond a cutoff rejects; ``cutoffs`` run from lenient to strict."""
    name: str
    value: str
    cutoffs: tuple[float, ...]
    above: bool = True


RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)",
         (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)",
         (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)",
         (0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    Rule("long_words", "word_chars / greatest(n_words, 1)",
         (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    Rule("short_words", "word_chars / greatest(n_words, 1)",
         (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5), above=False),
)


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_lines (lines with a
    word), n_dup_lines, n_repeat_words, base_failed.  One row per input row;
    null texts have no words."""
    plain = F.lit("[^" + SPACE_RUN[1:-2] + "]")
    t = docs.select(*keep, text_of(text).alias("_t"))
    t = t.select("*", split_words(F.col("_t")).alias("_w"),
                 F.filter(F.split("_t", "\n", -1), lambda x: F.rlike(x, plain)).alias("_lines"))
    hashes = F.when(F.size("_w") >= WINDOW,
                    F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)),
                                lambda i: F.xxhash64(F.slice("_w", i, F.lit(WINDOW)))))
    t = t.select(
        *keep, F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(hashes, F.array().cast("array<bigint>")).alias("_h"))
    # only texts in which some window repeats are looked at closely
    t = t.select("*", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, p: F.struct(h.alias("h"), p.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")).alias("_s"))

    t = t.select("*", F.filter("_s", lambda x, i: F.coalesce(
        F.get("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
        F.get("_s", i + 1)["h"] == x["h"], F.lit(False))).alias("_r")).drop("_h", "_s")
    spans = F.sort_array(F.transform("_r", lambda x: F.struct(x["p"].alias("s"), (x["p"] + WINDOW).alias("e"))))
    t = t.withColumn("n_repeat_words", covered(spans)).drop("_r")
    return t.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, stepped back."""
    y = x + F.lit(8.0)
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) \
        - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = F.log(x)
    for i in range(1, 8):
        back = back + F.log(x + float(i))
    return series - back


def binomial_lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to rounding.  Terms are added downwards from k;
    below the mean they fall at least geometrically, and those more than
    40 sqrt(n) + 60 places away are below any double's precision.  1 when k is
    at or above the mean, where no useful cutoff lies."""
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1)
                + kd * math.log(p) + (nd - kd) * math.log1p(-p))
    first = F.greatest(F.lit(0).cast("long"), k - F.ceil(40 * F.sqrt(nd)).cast("long") - 60)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:  # from term j to term j - 1
        term = acc["term"] * j / (nd - j + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    down = F.when(k > 0, F.sequence(k, first + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(down, zero, step, lambda acc: acc["sum"]) * top
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def _violated(rule: Rule) -> Column:
    """How many of the rule's cutoffs the row violates (they are ordered)."""
    value, out = F.expr(rule.value), F.lit(0)
    for c in rule.cutoffs:
        out = out + F.when(value > c if rule.above else value < c, 1).otherwise(0)
    return out


def certified_cutoffs(good: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES,
                      max_false_rejection: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per stratum and rule with a certified cutoff: ``stratum, rule, n,
    k, cutoff``.  ``good`` holds the measures of labelled good documents that
    pass the base rules."""
    levels = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(i + 1).alias("level"), F.lit(float(c)).alias("cutoff"))
                       for r in rules for i, c in enumerate(r.cutoffs)])
    # who violates a cutoff violates all stricter ones: the levels from `first` on
    broken = F.array(*[F.struct(F.lit(r.name).alias("rule"), (len(r.cutoffs) + 1 - _violated(r)).alias("first"),
                                F.lit(len(r.cutoffs)).alias("last")) for r in rules])
    key = F.col(stratum).alias("_stratum")
    n = good.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n_strata = good.agg(F.count_distinct(F.struct(key)).alias("n_strata"))
    grid = n.select("_stratum", "n", F.explode(levels).alias("g")).select("_stratum", "n", "g.*")
    hit = good.select(key, F.explode(broken).alias("b")).where("b.first <= b.last") \
        .groupBy("_stratum", "b.rule", "b.first", "b.last").agg(F.count(F.lit(1)).alias("hits")) \
        .select("_stratum", "rule", F.explode(F.sequence("first", "last")).alias("level"), "hits") \
        .groupBy("_stratum", "rule", "level").agg(F.sum("hits").alias("hits"))
    g = grid.alias("g").join(hit.alias("h"), F.col("g._stratum").eqNullSafe(F.col("h._stratum"))
                             & (F.col("g.rule") == F.col("h.rule")) & (F.col("g.level") == F.col("h.level")), "left") \
        .select("g.*", F.coalesce("h.hits", F.lit(0).cast("long")).alias("k"))
    strata = n_strata.first()["n_strata"]  # one number
    p = binomial_lower_tail(F.col("k"), F.col("n"), max_false_rejection / len(rules))
    return g.withColumn("p", p).where(F.col("p") <= delta / (max(strata, 1) * len(rules))) \
        .groupBy(F.col("_stratum").alias("stratum"), "rule") \
        .agg(F.max_by(F.struct("n", "k", "cutoff"), "level").alias("b")).select("stratum", "rule", "b.*")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang",
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``kept``: false for rows that fail the base rules or lie beyond a
    certified cutoff of their stratum."""
    wide = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_cut_{r.name}") for r in rules]) \
        .withColumnRenamed("stratum", "_cut_stratum")
    out = measured.join(wide, measured[stratum].eqNullSafe(wide["_cut_stratum"]), "left")
    bad = F.col("base_failed")
    for r in rules:
        value, cut = F.expr(r.value), F.col(f"_cut_{r.name}")
        bad = bad | F.coalesce(value > cut if r.above else value < cut, F.lit(False))
    return out.withColumn("kept", ~bad).drop("_cut_stratum", *[f"_cut_{r.name}" for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  stratum: str = "lang", max_false_rejection: float = 0.01, delta: float = 0.05,
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict per row of ``docs``, with ``rk``, the text's hash.

    ``labels`` has ``doc_id`` and ``quality`` (1 good).  Ids labelled more than
    once are good if any label says so; rows of ``docs`` that repeat an id count
    once each.  A null stratum is a stratum of its own, null ids match no label,
    null texts have no words and fail.  Empty tables give an empty result."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("lang"), F.col(text).alias("text"),
                    row_key(F.col(text)).alias("rk"))
    m = stage(measures(d, keep=("doc_id", "lang", "rk")), "quality-measures")
    ids = labels.where("quality = 1").select(F.col(doc_id).alias("_id")).distinct()
    good = m.where("NOT base_failed").join(ids, m["doc_id"] == F.col("_id"), "left_semi")
    cut = stage(certified_cutoffs(good, "lang", rules, max_false_rejection, delta), "quality-cutoffs")
    return judge(m, cut, "lang", rules)
