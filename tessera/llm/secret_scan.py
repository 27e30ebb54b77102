"""Secret scan: fixed patterns plus a randomness test battery.

The patterns give the base spans.  The method adds *random* spans: maximal runs
of key characters that look drawn at random.  For each run an encoding is
inferred (the smallest of decimal, hex, base32, alphanumeric, base64 whose
alphabet holds every character).  What base spans leave of a run is tested too.
A run that mixes the separators of two alphabets fits none: it is cut at either
pair of separators and at all of them, and every piece is tested; pieces found
that overlap are one span.  Three tests against "random over that
alphabet" follow: chi-squared uniformity of the alphabet, a runs test of the
symbols above and below the middle, and the lag-1 serial correlation.  A run
that any of them rejects (Bonferroni over the three) is not random.

Passing those tests proves little for short runs, so each run also gets a
p-value against "ordinary text": the same chi-squared statistic is far larger
for text, whose characters repeat with a known higher rate, and its lower tail
under that rate is the chance that ordinary text looks this even.  Its spread
shrinks with the length, so the test knows how much a length can show.
Benjamini-Hochberg then bounds the false discoveries within each length class
(powers of two) over all runs of the input.  The ranks come from counts per
p-value bin (never a global sort), each bin standing for its largest p, which
only makes the bound stricter.

All work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sha256_hex, stage, text_of

_KEYWORD = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
            "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
#: kind -> pattern, group whose length counts, least length.
BASE = {
    "assign": (_KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A cheap test that no match with the needed length can fail.
_MAY = {"assign": _KEYWORD + r"[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
ORDER = {k: i for i, k in enumerate((*BASE, "random"))}
CANDIDATE = r"[A-Za-z0-9+/_-]+"
MIN_RANDOM = 20
SEPARATORS = "/+-_"
#: Encodings from the smallest alphabet on; order gives the symbols' values.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Chance that two characters of ordinary words agree, for words that happen to
#: fit the alphabet (few letters fit hex, so they agree more often).
TEXT_COLLISION = {"decimal": 0.15, "hex": 0.26, "hex_upper": 0.26}
OTHER_COLLISION = 0.065


_SPAN = "struct<s:bigint,e:bigint,kind:string,n:int,value:string>"
#: Lists that grow step by step are kept in blocks of this many entries, so that a
#: step copies one block and not the list.
BLOCK = 64


def _blocks(kind: str) -> list[Column]:
    """The fields of an empty list of ``kind`` that :func:`_pushed` extends."""
    return [F.array().cast(f"array<{kind}>").alias("block"), F.array().cast(f"array<array<{kind}>>").alias("done")]


def _pushed(acc: Column, more: Column) -> list[Column]:
    """The list's fields with the entries of ``more`` (few) behind it."""
    full = F.size(acc["block"]) >= BLOCK
    return [F.when(full, more).otherwise(F.concat(acc["block"], more)).alias("block"),
            F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done")]


def _listed(acc: Column) -> Column:
    return F.flatten(F.concat(acc["done"], F.array(acc["block"])))


def _spans(t: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of all leftmost matches whose ``group`` is long enough.  The gaps
    (a split by the pattern) and the matches alternate, so running sums of
    their lengths are the offsets, in code points."""
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.char_length(x["gap"])
        e = s + F.char_length(x["whole"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"), F.lit(ORDER[kind]).alias("n"),
                               x["whole"].alias("value")))
        more = _pushed(acc, one)
        long = F.char_length(x["part"]) >= least
        return F.struct(F.coalesce(e, acc["at"]).alias("at"), *[F.when(long, m).otherwise(acc[n]).alias(n)
                                                                for m, n in zip(more, ("block", "done"), strict=True)])

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), *_blocks(_SPAN)), step, _listed)


def _rest(runs: Column, base: Column, least: int) -> Column:
    """What base spans leave of runs (apart from each other), without separators
    at its ends; a run itself if they leave it alone.  One sweep over the starts
    of both: ``run`` is the open run, ``at`` where its rest begins, ``hit``
    whether a base span meets it, ``covered`` the end of the base spans so far."""
    none = F.lit(None).cast(_SPAN)
    starts = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), none.alias("run"))),
        F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r.alias("run")))))

    def piece(run: Column, at: Column, end: Column) -> Column:
        whole = F.substring(run["value"], (at - run["s"] + 1).cast("int"), F.greatest(F.lit(0), end - at).cast("int"))
        left = F.ltrim(whole, F.lit(SEPARATORS))
        value = F.rtrim(left, F.lit(SEPARATORS))
        s = at + F.char_length(whole) - F.char_length(left)
        one = F.array(F.struct(s.alias("s"), (s + F.char_length(value)).alias("e"), run["kind"].alias("kind"),
                               run["n"].alias("n"), value.alias("value")))
        return F.when((end - at >= least) & (F.char_length(value) >= least), one).otherwise(F.array().cast(f"array<{_SPAN}>"))

    def closed(acc: Column) -> Column:
        run = acc["run"]
        return F.when(run.isNull(), F.array().cast(f"array<{_SPAN}>")).when(acc["hit"], piece(run, acc["at"], run["e"])) \
            .otherwise(F.array(run))

    def step(acc: Column, x: Column) -> Column:
        opens = x["run"].isNotNull()
        meets = acc["run"].isNotNull() & (x["s"] < acc["run"]["e"])
        more = F.when(opens, closed(acc)).when(meets, piece(acc["run"], acc["at"], x["s"])).otherwise(F.array().cast(f"array<{_SPAN}>"))
        return F.struct(F.when(opens, x["run"]).otherwise(acc["run"]).alias("run"),
                        F.when(opens, F.greatest(x["s"], acc["covered"])).when(meets, F.greatest(acc["at"], x["e"]))
                        .otherwise(acc["at"]).alias("at"),
                        F.when(opens, acc["covered"] > x["s"]).otherwise(acc["hit"] | meets).alias("hit"),
                        F.when(opens, acc["covered"]).otherwise(F.greatest(acc["covered"], x["e"])).alias("covered"),
                        *_pushed(acc, more))

    zero = F.struct(none.alias("run"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("hit"),
                    F.lit(0).cast("long").alias("covered"), *_blocks(_SPAN))
    return F.aggregate(starts, zero, step, lambda acc: F.concat(_listed(acc), closed(acc)))


def _pieces(run: Column, least: int) -> Column:
    """A run that fits no alphabet cut at '/' and '+', at '-' and '_', and at all four; other runs whole."""
    cut = F.concat(*[_spans(run["value"], "random", p, 0, least) for p in (r"[A-Za-z0-9_-]+", r"[A-Za-z0-9+/]+", r"[A-Za-z0-9]+")])
    moved = F.transform(cut, lambda x: F.struct((x["s"] + run["s"]).alias("s"), (x["e"] + run["s"]).alias("e"),
                                                x["kind"].alias("kind"), x["n"].alias("n"), x["value"].alias("value")))
    mixed = F.rlike(run["value"], F.lit("[+/]")) & F.rlike(run["value"], F.lit("[_-]"))
    return F.when(mixed, F.array_distinct(moved)).otherwise(F.array(run))


def _united(spans: Column) -> Column:
    """Sorted spans; those that overlap as one."""
    kind = "struct<s:bigint,e:bigint,kind:string,n:int>"

    def last(acc: Column) -> Column:
        return F.when(acc["last"].isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(acc["last"]))

    def step(acc: Column, x: Column) -> Column:
        meets = acc["last"].isNotNull() & (x["s"] < acc["last"]["e"])
        grown = acc["last"].withField("e", F.greatest(acc["last"]["e"], x["e"]))
        return F.struct(F.when(meets, grown).otherwise(x).alias("last"),
                        *[F.when(meets, acc[n]).otherwise(m).alias(n) for m, n in zip(_pushed(acc, last(acc)), ("block", "done"), strict=True)])

    return F.aggregate(F.sort_array(spans), F.struct(F.lit(None).cast(kind).alias("last"), *_blocks(kind)), step,
                       lambda acc: F.concat(_listed(acc), last(acc)))


def normal_cdf(z: Column) -> Column:
    """Phi(z) by a rational approximation of the complementary error function,
    relative error below 2e-7 in both tails.  The coefficients are fixed values."""
    x = F.abs(z) / (2.0 ** 0.5)
    u = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368,
              -1.26551223):
        poly = poly * u + c
    tail = u * F.exp(-x * x + poly) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def battery(runs: DataFrame, value: str = "value") -> DataFrame:
    """Add ``encoding``, ``p_random`` (smallest of the three tests' p-values
    against randomness, Bonferroni-corrected) and ``p_text`` (against ordinary
    text) to rows of runs.  Runs that no alphabet holds get nulls."""
    v = F.col(value)
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, chars in reversed(ALPHABETS.items()):
        fits = F.char_length(F.translate(v, chars, "")) == 0
        encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, F.lit(chars)).otherwise(alphabet)
    d = runs.withColumn("encoding", encoding).withColumn("_abc", alphabet)
    d = d.withColumn("_n", F.char_length(v).cast("double")).withColumn("_a", F.char_length("_abc").cast("double"))
    d = d.withColumn("_v", F.expr(
        f"transform(filter(split({value}, ''), c -> c <> ''), c -> CAST(locate(c, _abc) - 1 AS DOUBLE))"))
    counts = F.expr(f"transform(filter(split(_abc, ''), c -> c <> ''), c -> CAST(length({value}) - length(replace({value}, c, '')) AS DOUBLE))")
    d = d.withColumn("_chi", F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * F.col("_a") / F.col("_n") - F.col("_n"))
    # chi-squared upper tail by the cube-root normal approximation
    df = F.col("_a") - 1
    z_chi = (F.pow(F.greatest(F.col("_chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # runs above and below the middle of the alphabet
    d = d.withColumn("_up", F.expr("transform(_v, x -> IF(x >= _a / 2, 1D, 0D))"))
    d = d.withColumn("_n1", F.aggregate("_up", F.lit(0.0), lambda s, x: s + x))
    d = d.withColumn("_runs", F.expr(
        "aggregate(_up, struct(-1D AS last, 0D AS n), (s, x) -> struct(x AS last, s.n + IF(x = s.last, 0D, 1D) AS n), s -> s.n)"))
    n0 = F.col("_n") - F.col("_n1")
    mean = 2 * F.col("_n1") * n0 / F.col("_n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("_n") - 1)
    z_runs = F.when(var > 0, F.abs(F.col("_runs") - mean) / F.sqrt(var)).otherwise(F.lit(9.0))
    # lag-1 serial correlation around the alphabet's middle
    d = d.withColumn("_sc", F.expr(
        "aggregate(_v, struct(CAST(NULL AS DOUBLE) AS last, 0D AS s), (acc, x) -> struct(x - (_a - 1) / 2 AS last,"
        " acc.s + coalesce(acc.last * (x - (_a - 1) / 2), 0D) AS s), acc -> acc.s)"))
    sigma2 = (F.col("_a") * F.col("_a") - 1) / 12
    z_serial = F.abs(F.col("_sc")) / (sigma2 * F.sqrt(F.col("_n") - 1))
    p_random = F.least(1 - normal_cdf(z_chi), 2 * (1 - normal_cdf(z_runs)), 2 * (1 - normal_cdf(z_serial)))
    # the same chi-squared under ordinary text with its collision rate: pairs that agree
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    agree = (F.col("_chi") + F.col("_n")) * F.col("_n") / F.col("_a") / 2 - F.col("_n") / 2
    rate = F.lit(OTHER_COLLISION)
    for name, r in TEXT_COLLISION.items():
        rate = F.when(F.col("encoding") == name, r).otherwise(rate)
    z_text = (agree - pairs * rate + 0.5) / F.sqrt(pairs * rate)
    return d.withColumn("p_random", F.least(F.lit(1.0), 3 * p_random)).withColumn("p_text", normal_cdf(z_text)) \
        .drop("_abc", "_a", "_v", "_chi", "_up", "_n1", "_runs", "_sc", "_n")


def discoveries(tested: DataFrame, q: float, classes: str = "size_class", p: str = "p_text") -> DataFrame:
    """Largest p that Benjamini-Hochberg accepts per class, from counts per bin
    of 1/8 of a natural logarithm; at most some thousand rows per class."""
    binned = tested.select(classes, F.floor(-8 * F.log(F.greatest(F.col(p), F.lit(1e-300)))).alias("bin")) \
        .groupBy(classes, "bin").agg(F.count(F.lit(1)).alias("n"))
    bins = binned.groupBy(classes).agg(F.sum("n").alias("total"), F.sort_array(
        F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))  # from the smallest p on; bounded by the bins
    best = F.expr(f"""aggregate(bins, struct(0L AS seen, CAST(NULL AS DOUBLE) AS best), (s, x) -> struct(s.seen + x.n AS seen,
        IF(exp(-x.bin / 8) <= {q} * (s.seen + x.n) / total, exp(-x.bin / 8), s.best) AS best), s -> s.best)""")
    return bins.select(classes, best.alias("p_max"))


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), q: float = 0.01,
                 p_random: float = 0.001, min_random: int = MIN_RANDOM) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, ``base`` and ``spans``, arrays
    of ``struct(s, e, kind)`` in code points, sorted by start, then kind.

    A null or empty text has no span.  Repeated rows and ids are judged row by
    row (the tests of a run do not depend on the row it stands in), null ids
    included.  Random spans never overlap base spans; empty input, empty output."""
    d = docs.select(*keep, text_of(text).alias("_t"))
    none = F.array().cast("array<struct<s:bigint,e:bigint,kind:string,n:int,value:string>>")
    found = [F.when(F.rlike("_t", F.lit(_MAY[k])), _spans(F.col("_t"), k, *BASE[k])).otherwise(none) for k in BASE]
    long_run = F.rlike("_t", F.lit(CANDIDATE[:-1] + "{%d}" % min_random))
    runs = F.when(long_run, _spans(F.col("_t"), "random", CANDIDATE, 0, min_random)).otherwise(none)
    d = d.select(*keep, F.concat(*found).alias("base"), runs.alias("runs"))
    clear = F.when(F.size("runs") == 0, F.col("runs")).when(F.size("base") == 0, F.col("runs")) \
        .otherwise(_rest(F.col("runs"), F.col("base"), min_random))
    d = stage(d.select(F.monotonically_increasing_id().alias("_uid"), *keep,
                       F.transform("base", lambda b: b.dropFields("value")).alias("base"), clear.alias("runs")),
              "secret-spans")
    runs = d.select("_uid", F.explode("runs").alias("r")).select("_uid", F.explode(_pieces(F.col("r"), min_random)).alias("r"))
    tested = battery(runs.select("_uid", "r.*"))
    tested = stage(tested.where(F.col("p_random") >= p_random)
                   .withColumn("size_class", F.floor(F.log2(F.char_length("value").cast("double"))))
                   .select("_uid", "s", "e", "kind", "n", "p_text", "size_class"), "secret-tests")
    # one row per power of two of the length: at most 31
    limit = discoveries(tested, q).where("p_max IS NOT NULL")
    more = tested.join(F.broadcast(limit), "size_class").where("p_text <= p_max") \
        .groupBy(F.col("_uid").alias("_more")).agg(_united(F.collect_list(F.struct("s", "e", "kind", "n"))).alias("random"))
    out = d.join(more, F.col("_uid") == F.col("_more"), "left")
    ordered = lambda spans: F.transform(
        F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), x["e"].alias("e"),
                                                           x["kind"].alias("kind")))),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    every = F.when(F.col("random").isNull(), F.col("base")).otherwise(F.concat("base", "random"))
    return out.select(*keep, ordered(F.col("base")).alias("base"), ordered(every).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def digest(result: DataFrame) -> DataFrame:
    """The columns of the query: counts per base kind, hash of the base spans, all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return result.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                         sha256_hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
