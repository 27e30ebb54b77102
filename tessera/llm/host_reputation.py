"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host, per registered domain
and per suffix.  A beta-binomial model ties the levels together: the bad rate of
a suffix is shrunk towards that of all pages, the rate of a domain towards its
suffix's, the rate of a host towards its domain's.  How strongly is learned from
the counts themselves: the spread of the groups' rates beyond binomial noise
(method of moments) gives each level's prior weight.  A host is blocked if the
lower bound of its bad rate's posterior is above ``max_bad``, so a host with few
bad pages is not blocked on them alone, and one without any label follows its
domain.

Counts are combined before every shuffle; the statistics of a level are sums
over its groups.  Verdicts are broadcast when a count shows that the hosts are
few; else pages and hosts are joined by hash, with the pages of a host spread
over ``SALTS`` parts.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import f_sf
from tessera.llm.common import ascii_lower, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

#: (verdict, host, path): of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
#: Suffixes of more than one label under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn")
BROADCAST_HOSTS = 100_000
SALTS = 32
#: Prior weight where no group of a level has two labelled pages.
PLAIN_WEIGHT = 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return (ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)),
            F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1))


def registered(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user, port and final dots.
    An address of numbers is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"\A.*@", ""), r"(:[0-9]*)?\.*\z", "")
    many = "|".join(re.escape(s) for s in suffixes)
    suffix = F.regexp_extract(name, rf"((?:\A|(?<=\.))(?:{many})|[^.]*)\z", 1)
    domain = F.regexp_extract(name, rf"((?:[^.]+\.)?(?:(?:\A|(?<=\.))(?:{many})|[^.]*))\z", 1)
    number = name.rlike(r"\A([0-9.]+|\[.*\])\z")
    return F.when(number, name).otherwise(domain), F.when(number, name).otherwise(suffix)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null without one.  A rule
    fits its host and all subdomains if the path starts with the rule's; of
    equally long ones the longer host wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def prior_weight(spread: float | None, scale: float | None) -> float:
    """Weight (alpha + beta) of a level's prior, from the sums over its groups of
    n * (squared deviation from the prior mean less its binomial part) and of
    what a full spread would make of it."""
    if spread is None or not scale or scale <= 0:
        return PLAIN_WEIGHT
    rho = min(max(spread / scale, 1e-4), 0.95)
    return 1 / rho - 1


def shrink(groups: DataFrame, mean: str, out: str) -> tuple[DataFrame, float]:
    """``groups`` (``n, bad`` and the prior mean) with the posterior mean ``out``
    and the prior weight learned from them."""
    m = F.greatest(F.least(F.col(mean), F.lit(1 - 1e-6)), F.lit(1e-6))
    rate, n = F.col("bad") / F.col("n"), F.col("n").cast("double")
    row = groups.where("n >= 2").agg(
        F.sum(n * ((rate - m) * (rate - m) - m * (1 - m) / n)), F.sum(n * m * (1 - m) * (1 - 1 / n))).first()
    weight = prior_weight(*row)
    return groups.withColumn(out, (F.col("bad") + weight * m) / (F.col("n") + weight)), weight


def lower_bound(alpha: float, beta: float, confidence: float) -> float:
    """The value that a beta variable exceeds with probability ``confidence``."""
    low, high = 0.0, 1.0
    for _ in range(30):
        x = (low + high) / 2
        if f_sf(x * beta / ((1 - x) * alpha), 2 * alpha, 2 * beta) >= confidence:
            low = x
        else:
            high = x
    return low


def reputation(outcomes: DataFrame, confidence: float = 0.95,
               suffixes: Sequence[str] = SUFFIXES) -> tuple[DataFrame, DataFrame, float]:
    """Posteriors from ``outcomes`` (``host, bad`` 0 or 1, one row per labelled page).

    Returns the hosts (``host, n, bad, mean, bound``), the domains that hosts
    without labels fall back to (``domain, suffix, mean, bound``; rows with a
    null domain stand for the whole suffix, the row without either for all), and
    the hosts' prior weight.  Without any label the rate is one half and
    nothing is certain."""
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = stage(hosts.withColumns({"domain": domain, "suffix": suffix}), "host-counts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = (bad + 0.5) / (n + 1) if n else 0.5
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    ends, w_suffix = shrink(hosts.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(overall)), "prior", "mean")
    ends = stage(ends, "suffix-rates")
    names = hosts.groupBy("domain", "suffix").agg(*counts).join(ends.select("suffix", F.col("mean").alias("prior")), "suffix")
    names, w_domain = shrink(names, "prior", "mean")
    names = stage(names, "domain-rates")
    own = hosts.select("host", "n", "bad", "domain", "suffix").join(
        names.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])
    own, w_host = shrink(stage(own, "host-priors"), "prior", "mean")

    @F.pandas_udf("double")
    def bound(alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([lower_bound(a, b, confidence) for a, b in zip(alpha, beta, strict=True)], dtype="float64")

    def bounded(df: DataFrame, n: Column, weight: float) -> DataFrame:
        """The bound of a rate with the given mean and n + weight pages behind it."""
        total = n + F.lit(float(weight))
        return df.withColumn("bound", bound(F.col("mean") * total, (1 - F.col("mean")) * total))

    own = stage(bounded(own, F.col("n").cast("double"), w_host).select("host", "n", "bad", "mean", "bound"), "host-rates")
    # a host without labels is a draw from its domain's prior
    nothing = F.lit(0.0)
    spark = outcomes.sparkSession
    top = spark.createDataFrame([(None, None, float(overall))], "domain string, suffix string, mean double")
    rest = names.select("domain", "suffix", "mean").unionByName(
        ends.select(F.lit(None).cast("string").alias("domain"), "suffix", "mean")).unionByName(top)
    rest = stage(bounded(rest, nothing, w_host), "fallback-rates")
    return own, rest, w_host


def outcomes_from_documents(pages: DataFrame, docs: DataFrame, labels: DataFrame, min_chars: int = 60) -> DataFrame:
    """Labelled pages: ``host, bad``, one row per page of ``pages`` (``page_id,
    url, html``) that shows text of a labelled document.

    A page's paragraphs and a document's lines are matched by their hashes.  A
    line stands for the labels of all labelled documents that hold it; a page is
    bad if the lines it shows are, weighted equally, mostly from documents of no
    quality or toxic ones.  Lines are reduced to one row each before the join."""
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    known = labels.select("doc_id", bad.alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    # texts become hashes where they are read: only those are shuffled
    long_lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: F.char_length(x) >= min_chars)
    lines = docs.select("doc_id", F.transform(long_lines, lambda x: F.xxhash64(x)).alias("hashes")).where(F.size("hashes") > 0)
    lines = lines.join(known, "doc_id").select("bad", F.explode("hashes").alias("h")).groupBy("h").agg(F.avg("bad").alias("bad"))
    shown = pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"), F.explode(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("<p>([^<]*)</p>"), 1)).alias("line"))
    plain = F.col("line")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    shown = shown.select("page_id", "host", F.trim(plain).alias("line")).where(F.char_length("line") >= min_chars) \
        .select("page_id", "host", F.xxhash64("line").alias("h"))
    return shown.join(lines, "h").groupBy("page_id", "host").agg(F.avg("bad").alias("bad")) \
        .select("host", (F.col("bad") > 0.5).cast("int").alias("bad"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = 0.5, confidence: float = 0.95,
                suffixes: Sequence[str] = SUFFIXES, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict`` and
    the posterior behind it (``n_labelled, n_bad, bad_rate, bad_bound``).

    The longest fitting rule decides; without one the host is blocked if its bad
    rate is above ``max_bad`` with probability ``confidence``.  A url that is
    null or without ``://`` has an empty host and path, which are judged like any
    other.  Repeated pages are judged alike, other columns are not read, an empty
    table gives an empty result."""
    hosts, rest, _ = reputation(outcomes, confidence=confidence, suffixes=suffixes)
    host, path = host_and_path(F.col(f"`{url}`"))
    d = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    asked = d.select("host").distinct()
    domain, suffix = registered(F.col("host"), suffixes)
    asked = asked.withColumns({"_d": domain, "_s": suffix})

    def fallback(kind: Column, name: str, *keys: str) -> DataFrame:
        return rest.where(kind).select(*[F.col(k).alias(f"_{k}") for k in keys],
                                       F.struct("mean", "bound").alias(name))
    by_domain = fallback(F.col("domain").isNotNull(), "of_domain", "domain", "suffix")
    by_suffix = fallback(F.col("domain").isNull() & F.col("suffix").isNotNull(), "of_suffix", "suffix") \
        .withColumnRenamed("_suffix", "_end")
    top = rest.where("suffix IS NULL").select("mean", "bound").first()  # one row
    everywhere = F.struct(F.lit(top["mean"]).alias("mean"), F.lit(top["bound"]).alias("bound"))
    own = hosts.select(F.col("host").alias("_host"), "n", "bad", F.struct("mean", "bound").alias("of_host"))
    judged = asked.join(own, F.col("host") == F.col("_host"), "left") \
        .join(by_domain, (F.col("_d") == F.col("_domain")) & (F.col("_s") == F.col("_suffix")), "left") \
        .join(by_suffix, F.col("_s") == F.col("_end"), "left")
    best = F.coalesce("of_host", "of_domain", "of_suffix", everywhere)
    judged = stage(judged.select("host", F.coalesce("n", F.lit(0)).alias("n_labelled"), F.coalesce("bad", F.lit(0)).alias("n_bad"),
                                 best["mean"].alias("bad_rate"), best["bound"].alias("bad_bound")), "host-verdicts")
    if judged.count() <= broadcast_hosts:
        d = d.join(F.broadcast(judged), "host")
    else:
        salted = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"])
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return d.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                    "n_labelled", "n_bad", "bad_rate", "bad_bound")

