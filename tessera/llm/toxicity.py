"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text.  The toxic one sees the toxic documents reduced to the words that lean
toxic (their share of toxic documents exceeds that of ordinary ones by a z-score
of ``min_z``), because what toxic and ordinary text have in common says nothing.
It holds every leaning word at least once: its size follows from the words found
(once or twice their bytes, ``toxic_size`` at least, as the calibration documents
choose).  The bound is ``most`` bytes, zstandard's usual 110 KB, and ``max_words``
words; of more words those that lean most stay.
Both compressors use the ordinary dictionary, the second one the toxic
dictionary as well, so their outputs differ only where toxic material helps.

A text is cut into windows of about ``window`` bytes at word ends.  Each window
is compressed twice; the difference of the lengths is its evidence.  A window
counts as toxic above a threshold that at most ``window_risk`` of the windows of
ordinary calibration documents exceed.  A logistic model over the document's
evidence (mean, largest, share of toxic windows, number of windows), fitted on
calibration documents that no dictionary has seen, gives the score.

What is learnt comes from bounded samples of the labelled rows (about
``max_docs`` of each class, and as many windows of each, for the dictionaries,
``max_docs`` for the calibration, chosen by hash); scoring is one pass over all
texts without a shuffle.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, map_texts, split_words, stage, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

#: Marks at the ends of words that do not belong to them.
MARKS = ".,;:!?\"'()"
THRESHOLDS = np.arange(1, 33)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    window: int
    threshold: int
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    base_rate: float


def windows(text: str, size: int) -> list[bytes]:
    """The whole text, A-Z in lower case, in pieces of whole words of about ``size`` bytes."""
    out, held, n = [], [], 0
    for word in text.encode("utf-8", "surrogatepass").lower().split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def compressor(dictionary: bytes, span: int = 0):
    """``span``: bytes of the largest dictionary that is compared."""
    import zstandard as z

    # every position of the dictionary must be in the tables
    log = max(14, (span - 1).bit_length())
    params = z.ZstdCompressionParameters(
        window_log=17, hash_log=log, chain_log=log, search_log=4, min_match=4, strategy=z.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    if not dictionary:
        return z.ZstdCompressor(compression_params=params)
    content = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=params)
    return z.ZstdCompressor(compression_params=params, dict_data=content)


def train_dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """A zstandard dictionary; with too few samples to train one, the samples
    themselves, newest bytes of ``size``."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, **cover).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def with_words(dictionary: bytes, words: list[bytes], most: int) -> bytes:
    """The dictionary after those of ``words`` (strongest first) that it lacks.
    If that is above ``most`` bytes the words alone, and of them the strongest."""
    held = set(re.split(rb"[ \t\n\x0b\x0c\r]+", dictionary)[1:-1])
    missing: list[bytes] = []
    size = 2
    for w in words:
        if w not in held:
            if size + len(w) + 1 > most:
                break
            missing.append(w)
            size += len(w) + 1
    added = b" " + b" ".join(missing[::-1]) + b" " if missing else b""
    room = most - len(added)
    if len(dictionary) > room:
        return with_words(b"", words, most)
    return added + dictionary


def _evidence(ordinary: bytes, toxic: bytes, size: int):
    span = len(toxic) + len(ordinary)
    plain, primed = compressor(ordinary, span).compress, compressor(toxic + ordinary, span).compress

    def of(text: str) -> tuple[np.ndarray, int]:
        pieces = windows(text, size)
        gain = np.array([len(plain(w)) - len(primed(w)) for w in pieces], np.int64)
        return gain, sum(map(len, pieces))

    return of


def _features(mean, largest, share, n):
    return np.column_stack([mean, np.sqrt(np.maximum(mean, 0)), largest, share, np.sqrt(share), np.log1p(n)])


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _about(rows: DataFrame, group: str, hashed: str, n: int) -> DataFrame:
    """About ``n`` rows of each of a few groups (all rows of smaller ones): those
    whose hash is below the share.  No sort, and no task sends more than its part."""
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    low = F.pmod(F.col(hashed), F.lit(1 << 30))
    keep = F.lit(False)
    for g, size in sizes.items():
        keep = keep | ((F.col(group) == g) & (low < math.ceil(n / size * (1 << 30))))
    return rows.where(keep)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = 20_000,
          window: int = 112, ordinary_size: int = 16384, toxic_size: int = 1600, min_z: float = 6.0, min_docs: int = 5,
          max_words: int = 20_000, window_risk: float = 0.01, calibration: float = 0.25, most: int = 112_640) -> Model:
    """Learn from the rows of ``labels`` (``doc_id, toxic``); ids labelled more
    than once are toxic if any label says so, null ids are left out.  Without
    both classes the model knows only the base rate."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull()) \
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")) \
        .withColumn("h", F.xxhash64("_id"))
    known = stage(known, "toxicity-labels")
    part = F.when(F.pmod(F.xxhash64("h"), F.lit(1000)) < int(1000 * calibration), "calibrate").otherwise("train")
    known = known.withColumn("part", part).withColumn("group", F.when(F.col("part") == "train", F.col("toxic")).otherwise(2))
    sample = stage(_about(known, "group", "h", max_docs).drop("group"), "toxicity-sample")  # about 3 * max_docs rows at most
    rows = stage(docs.select(F.col(doc_id).alias("_doc"), text_of(text).alias("text"))
                 .join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "h", "toxic", "part", "text"),
                 "toxicity-rows")
    sizes = {r["toxic"]: r["n"] for r in rows.where("part = 'train'").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = known.agg(F.avg("toxic").alias("rate")).first()["rate"]
    nothing = Model(b"", b"", window, 1, (0.0,) * 7, (0.0,) * 6, (1.0,) * 6, float(total or 0.0))
    if not sizes.get(0) or not sizes.get(1):
        return nothing

    # words that lean toxic, by the documents that hold them
    words = rows.where("part = 'train'").select("toxic", F.explode(F.array_distinct(F.transform(
        split_words(ascii_lower(F.col("text"))), lambda w: F.btrim(w, F.lit(MARKS))))).alias("word")).where("word <> ''")
    seen = words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    n1, n0 = float(sizes[1]), float(sizes[0])
    share = F.col("n") / (n0 + n1)
    z = (F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    lean = [r["word"] for r in seen.where((F.col("a") >= min_docs) & (share < 1)).withColumn("z", z).where(F.col("z") > min_z)
            .orderBy(F.desc("z"), "word").limit(max_words).select("word").collect()]
    chosen = frozenset(w.encode() for w in lean)
    ends = MARKS.encode()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training windows: ordinary text whole, toxic text reduced to leaning words."""
        for b in batches:
            out, cls, order = [], [], []
            for h, c, t in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if c:
                    t = b" ".join(w for w in t.encode().lower().split() if w.strip(ends) in chosen).decode()
                for i, w in enumerate(windows(t, 256)):
                    out.append(w)
                    cls.append(c)
                    order.append((h ^ (i * 0x9E3779B97F4A7C15)) & ((1 << 62) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(cls, pa.int32()),
                                              pa.array(order, pa.int64())], ["w", "toxic", "o"])

    cut = map_texts(rows.where("part = 'train'").select("h", "toxic", "text"), pieces, "w binary, toxic int, o bigint")
    cut = stage(cut, "toxicity-windows")
    few = sorted(_about(cut, "toxic", "o", max_docs).select("toxic", "o", "w").collect())
    samples = [[bytes(r["w"]) for r in few if r["toxic"] == c] for c in (0, 1)]
    if not samples[0] or not samples[1]:
        return nothing
    ordinary = train_dictionary(samples[0], ordinary_size)
    leaning = [w.encode() for w in lean]
    once = sum(len(w) + 1 for w in leaning)
    sizes_tried = sorted({min(most, max(toxic_size, k * once)) for k in (1, 2)})
    toxics = [with_words(train_dictionary(samples[1], size, k=16, d=6), leaning, most) for size in sizes_tried]

    # calibration documents: the evidence of their windows, as counts above each threshold
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [_evidence(ordinary, toxic, window) for toxic in toxics]
        for b in batches:
            rows = []
            for c, t in zip(*[x.to_pylist() for x in b.columns], strict=True):
                for j, of in enumerate(each):
                    gain, n = of(t)
                    above = (gain[:, None] >= THRESHOLDS[None, :]).sum(0)
                    rows.append((j, c, len(gain), float(gain.sum()) / max(1, n), int(gain.max(initial=0)), above.tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(),
                                                       pa.list_(pa.int64())), strict=True)],
                ["tried", "toxic", "n", "mean", "largest", "above"])

    got = map_texts(rows.where("part = 'calibrate'").select("toxic", "text"), evidence,
                    "tried int, toxic int, n bigint, mean double, largest bigint, above array<bigint>").collect()
    best = None
    for j, toxic in enumerate(toxics):
        part = [r for r in got if r["tried"] == j]
        y = np.array([r["toxic"] for r in part], float)
        if not 0 < y.sum() < len(y):
            return Model(ordinary, toxic, window, 1, (0.0,) * 7, (0.0,) * 6, (1.0,) * 6, float(total))
        n, mean, largest = (np.array([r[k] for r in part], float) for k in ("n", "mean", "largest"))
        above = np.array([r["above"] for r in part], float)
        risk = above[y == 0].sum(0) / max(1.0, n[y == 0].sum())
        fine = np.flatnonzero(risk <= window_risk)
        threshold = int(THRESHOLDS[fine[0]]) if len(fine) else int(THRESHOLDS[-1])
        x = _features(mean, largest, above[:, threshold - 1] / np.maximum(n, 1), n)
        center, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        w = _fit_logistic((x - center) / scale, y)
        p = 1 / (1 + np.exp(-np.clip(w[0] + (x - center) / scale @ w[1:], -30, 30)))
        loss = -float(np.mean(np.log(np.where(y == 1, p, 1 - p))))
        if best is None or loss < best[0]:
            best = loss, Model(ordinary, toxic, window, threshold, tuple(w), tuple(center), tuple(scale), float(total))
    return best[1]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted, n_windows, n_toxic_windows`` per row of
    ``docs``.  A null or empty text has no window and gets the score of no
    evidence; repeated rows get equal rows; an empty table an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(model.ordinary, model.toxic, model.window)
        weights, center, scale = (np.array(x) for x in (model.weights, model.center, model.scale))
        blank = not np.any(weights)
        for b in batches:
            n, bad, mean, top = [], [], [], []
            for t in b.column(1):
                gain, size = of(t.as_py())
                n.append(len(gain))
                bad.append(int((gain >= model.threshold).sum()))
                mean.append(float(gain.sum()) / max(1, size))
                top.append(int(gain.max(initial=0)))
            n, bad = np.array(n, np.int64), np.array(bad, np.int64)
            x = _features(np.array(mean, float), np.array(top, float), bad / np.maximum(n, 1), n)
            p = np.full(len(n), model.base_rate) if blank else 1 / (1 + np.exp(-np.clip(
                weights[0] + (x - center) / scale @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n),
                                              pa.array(bad)], ["doc_id", "score", "predicted", "n_windows", "n_toxic_windows"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_texts(d, run, "doc_id bigint, score double, predicted int, n_windows bigint, n_toxic_windows bigint")
