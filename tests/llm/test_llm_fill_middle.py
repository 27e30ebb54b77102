"""Fill-in-the-middle against a plain code-point version."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward, empty, sample

from tessera.llm import fill_middle as FM

UNIT = re.compile("(?s)[A-Za-z]+|[^A-Za-z]")


def plain(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_plain_version(spark):
    rows = [*sample(), (77, "a <P> b", None, None, None), (78, "<", None, None, None), (79, "x<S", None, None, None),
            (80, "日本語😀abćé <M", None, None, None)]
    rows, d = awkward(spark, rows)
    want = sorted((str(r[0]), *map(str, plain(r[0], r[1]))) for r in rows)
    got = FM.fill_in_middle(d).collect()
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in got) == want
    text = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert sorted(r.restored_sha256 for r in got) == text
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert FM.fill_in_middle(empty(spark)).count() == 0


def test_marks_are_checked(spark):
    with pytest.raises(ValueError):
        FM.fill_in_middle(empty(spark), marks=("<P>", "<S>", "P"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ <>PSM\n.é日😀", max_size=40), st.integers(0, 10_000))
def test_round_trip(text, doc):
    marks = [m.encode() for m in FM.MARKS]
    n, form, prefix, middle, out = FM.split(text.encode(), FM.draws(doc, 1), 90, 20, marks)
    assert (n, form, prefix, middle, out.decode()) == plain(doc, text)
    assert FM.restore(out, form, marks) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é日😀́", max_size=40))
def test_exception_index(text):
    index = FM.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert [index.chars(b) for b in at] == list(range(len(text) + 1))
    assert [index.byte(k) for k in range(len(text) + 1)] == at
    assert len(index.at) == sum(len(c.encode()) > 1 for c in text)
