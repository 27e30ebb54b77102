"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as
many of the largest length as fit, then the binary digits of the rest, from
large to small.  Each piece is one sequence, so no sequence crosses documents
and nothing is padded; pieces of equal length form a bucket from which batches
of one shape are drawn (``bucket`` is the binary logarithm of the length).

Documents are tokenised where they are read; there is no shuffle.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

#: Characters tokenised at a time; bounds the ids a task holds.
CHUNK_CHARS = 1 << 20
_ENCODERS: dict = {}


def encoder(vocabulary: str, special: bool = False):
    """Encoder for a byte-level BPE vocabulary, kept per worker.  With ``special``
    the strings of special tokens in a text become those tokens, as ``tokenizers``
    does unless told otherwise; else they are ordinary text.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file.  The same
    vocabulary and merges are run through tiktoken, whose ids are the same and
    which is about five times faster; texts that it refuses go to tokenizers."""
    if (vocabulary, special) not in _ENCODERS:
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        # tokens that swallow neighbouring spaces or need word ends are left to tokenizers
        plain = not any(t[k] for t in model["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # byte-level alphabets write bytes as printable characters: printable Latin-1 as it is, the rest from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        ranks = {bytes(back[c] for c in w): i for w, i in model["model"]["vocab"].items() if i not in added.values()}
        # the pattern of byte-level pre-tokenisers, a fixed value
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def ordinary(text: str) -> np.ndarray:
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except BaseException as e:  # its regular expressions give up on huge runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                return exactly(text, False)

        def exactly(text: str, special: bool) -> np.ndarray:
            exact = Tokenizer.from_file(vocabulary)
            exact.encode_special_tokens = not special
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

        def encode(text: str) -> np.ndarray:
            if not (special and marks and marks.search(text)):
                return ordinary(text)
            if not plain:
                return exactly(text, True)
            parts = [np.array([added[x]], "<u4") if x in added else ordinary(x) for x in marks.split(text) if x]
            return np.concatenate(parts)

        _ENCODERS[vocabulary, special] = encode
    return _ENCODERS[vocabulary, special]


def cut(n: int, largest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    out = [(s, largest) for s in range(0, n - largest + 1, largest)]
    at = len(out) * largest
    for k in range(largest.bit_length() - 1, -1, -1):
        if (n - at) >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def _pieces(vocabulary: str, end: int, largest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special=True)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

        def flush(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            rows: list = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                for s, k in cut(len(ids), largest):
                    piece = ids[s:s + k]
                    rows.append((doc, s, k, zlib.crc32(piece.tobytes()), len(ids), *[piece.tolist()] * with_ids))
                held += len(text)
                if held >= CHUNK_CHARS:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return run


def pack_power_of_two(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = 0,
                      largest: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket`` and, ``with_ids``, the ids.

    ``largest`` must be a power of two.  A null or empty text is the ``end`` id
    alone.  Rows that share an id (or have none) are packed one by one.  An
    empty table gives no piece.  ``sequence_id`` is unique; as the partitions of
    a scan are, it is the same when a lost task runs again."""
    if largest & (largest - 1) or largest < 1:
        raise ValueError("largest must be a power of two")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    out = map_texts(d, _pieces(vocabulary, end, largest, with_ids), schema + ", ids array<int>" * with_ids)
    out = out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return out.withColumn("bucket", F.round(F.log2(F.col("length").cast("double"))).cast("int"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences, one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)
