"""Fill-in-the-middle transformation with a sparse exception index.

A text is cut into units (runs of ASCII letters, any other code point alone) and
two cuts turn it into prefix, middle and suffix, which are put out in an order
that lets a left-to-right model learn to fill gaps.

Cuts are found on the UTF-8 bytes.  Positions in bytes and in code points differ
only behind characters of more than one byte, so those are recorded as
*exceptions* (byte position, and the excess bytes up to and with each); a cut is
converted by one binary search, and a text without exceptions by plain
arithmetic.  No table of one entry per character is kept, and the text is never
decoded.

Each row is worked on where it is read; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package installed

#: Prefix, suffix and middle marks.
MARKS = ("<P>", "<S>", "<M>")
OUT_BYTES = 1 << 22


class ExceptionIndex:
    """Converts positions of a UTF-8 text between bytes and code points."""

    def __init__(self, data: np.ndarray):
        inside = np.flatnonzero((data & 0xC0) == 0x80)  # continuation bytes: only multibyte characters have them
        # the lead of a multibyte character is the byte before a run of them
        first = np.flatnonzero(np.diff(inside, prepend=-2) != 1) if len(inside) else inside
        self.at = inside[first] - 1
        self.excess = np.diff(np.append(first, len(inside))).cumsum() if len(inside) else inside
        # in code points, an exception stands where the excess of those before it is taken off
        self.char_at = self.at - np.concatenate([[0], self.excess[:-1]]) if len(inside) else inside

    def chars(self, byte: int) -> int:
        """Code points before a character boundary given in bytes."""
        k = int(np.searchsorted(self.at, byte, "left")) if len(self.at) else 0
        return byte - (int(self.excess[k - 1]) if k else 0)

    def byte(self, chars: int) -> int:
        """Byte position of a code point."""
        k = int(np.searchsorted(self.char_at, chars, "left")) if len(self.at) else 0
        return chars + (int(self.excess[k - 1]) if k else 0)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which units begin: every character but an ASCII letter
    that follows another."""
    folded = data | 0x20
    letter = (folded >= 0x61) & (folded <= 0x7A) & (data < 0x80)
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def draws(doc_id: object, seed: int) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def split(data: bytes, h: Sequence[int], fim: int, spm: int, marks: Sequence[bytes]) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    buffer = np.frombuffer(data, np.uint8)
    starts = unit_starts(buffer) if len(buffer) else np.empty(0, np.int64)
    n = len(starts)
    if not n or h[2] % 100 >= fim or any(m in data for m in marks):
        return n, "plain", None, None, data
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(data) for k in (low, high))
    index = ExceptionIndex(buffer)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm else "psm"
    out = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return n, form, index.chars(a), index.chars(b) - index.chars(a), out


def restore(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text back from its transformed form.  No mark stands in a transformed
    text, and none can arise where a text meets a mark (no mark's end begins one)."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    body, middle = output[len(first):].split(m)
    head, tail = body.split(second)
    return tail + middle + head if form == "spm" else head + middle + tail


def _mapper(seed: int, fim: int, spm: int, marks: tuple[str, ...], with_output: bool):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
             *["output"] * with_output]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             *[pa.binary()] * with_output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [m.encode() for m in marks]

        def flush(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            rows: list = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, form, prefix, middle, out = split(text.as_py(), draws(doc, seed), fim, spm, coded)
                rows.append((doc, n, form, prefix, middle, hashlib.sha256(out).hexdigest(),
                             hashlib.sha256(restore(out, form, coded)).hexdigest(), *[out] * with_output))
                held += len(out) * with_output
                if held >= OUT_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return run


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, fim_percent: int = 90,
                   spm_percent: int = 20, marks: Sequence[str] = MARKS, with_output: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n`` (units), ``form`` (plain, psm or
    spm), ``prefix_chars, middle_chars`` (code points, null if plain), the SHA-256
    of the output and of the text restored from it and, ``with_output``, the
    output as a string.

    ``marks`` are those of prefix, suffix and middle, each ``<``, other
    characters, ``>``.  A text that is null, empty or holds a mark stays plain, as
    do ``100 - fim_percent`` in a hundred.  Cuts depend on ``seed`` and the id
    alone: rows that share an id share their draws, a null id counts as the empty
    text.  Columns other than id and text are not read; an empty table gives an
    empty result."""
    if len(marks) != 3 or len(set(marks)) != 3 or any(
            len(m) < 3 or m[0] != "<" or m[-1] != ">" or set(m[1:-1]) & {"<", ">"} for m in marks):
        raise ValueError("three different marks are needed, each of the form <...>")
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, " \
             "restored_sha256 string" + ", output binary" * with_output
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").cast("binary").alias("text"))
    out = map_texts(d, _mapper(seed, fim_percent, spm_percent, tuple(marks), with_output), schema)
    return out.withColumn("output", F.col("output").cast("string")) if with_output else out
