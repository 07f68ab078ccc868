"""Words and windows of byte arrays against regular expressions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boutique.llm import arrays
from boutique.llm.arrays import SPACE_WORDS, TERM_WORDS, Words, covered, slices, window_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1é ,\t\n\x00漢", max_size=30)), max_size=8)


@pytest.mark.parametrize("piece", [3, 1 << 20])
@pytest.mark.parametrize(("table", "pattern", "fold"), [(SPACE_WORDS, r"[^\x20\x09-\x0D]+", False), (TERM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words_equal_regex(monkeypatch, piece, table, pattern, fold):
    monkeypatch.setattr(arrays, "PIECE", piece)

    @settings(max_examples=60, deadline=None)
    @given(TEXTS)
    def check(texts):
        got = Words(pa.array(texts, pa.string()), table)
        hashes = {}
        for r, t in enumerate(texts):
            t = t or ""
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t)
            a, b = got.offsets[r], got.offsets[r + 1]
            assert len(want) == b - a
            for w, s, e, h in zip(want, got.starts[a:b], got.ends[a:b], got.hashes[a:b], strict=True):
                assert table[got.buf[s:e]].tobytes() == w.encode().replace(b"\0", b" ")
                assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)

    check()


def test_windows_and_cover():
    h = np.array([5, 6, 5, 6, 5], np.uint64)
    first, w = window_hashes(h, np.array([0, 4, 4, 5]), 2)
    assert first.tolist() == [0, 1, 2] and w[0] == w[2] != w[1]
    assert window_hashes(h, np.array([0, 4, 5]), 9)[0].tolist() == []
    assert covered(np.array([0, 3]), 2, 6).tolist() == [True, True, False, True, True, False]


def test_slices_cover_the_batch():
    batch = pa.record_batch({"text": pa.array(["a" * 5, None, "b" * 50, "", "c"])})
    parts = list(slices(batch, "text", 10))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist() and len(parts) > 1
