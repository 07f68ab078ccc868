"""Op 8 against plain windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from boutique.llm import substring
from tests.llm.conftest import words


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    array = np.array(sorted(values), np.uint64)
    assert substring.unpack(substring.pack(array), np.uint64).tolist() == array.tolist()


@pytest.mark.parametrize(("run_windows", "buckets", "group_bytes"), [(2_000_000, None, 256 << 20), (500, 3, 256 << 20), (2_000_000, None, 4000)])
def test_equals_brute_force(corpus, monkeypatch, run_windows, buckets, group_bytes):
    """In runs and buckets of any size; with groups dealt to parts, one id holding a third of all rows."""
    monkeypatch.setattr(substring, "GROUP_BYTES", group_bytes)
    rng = random.Random(6)
    passage, few = words(rng, 40), words(rng, 12)
    rows = []
    for i in range(120):
        text = words(rng, rng.randint(0, 120), 3000)
        if i % 2 == 0:
            a = rng.randint(0, 20)
            text[len(text) // 2:len(text) // 2] = passage[a:a + rng.randint(5, 20)]
        if i % 5 == 0:
            text += few
        rows.append((i * 7 % 120 - 10, rng.choice([" ", "\n", "\t ", "  "]).join(text)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, rows[0][1]), (303, rows[0][1]), (304, " ".join(["same"] * 40)), (305, "same " * 20),
             (306, " ".join(words(rng, 40000))), (None, " ".join(passage)), (307, "nul\0word é " * 15)]
    rows += [(77, " ".join(words(rng, 20) + passage[:14 + k % 20])) for k in range(60)]
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict = {}
    low = -(1 << 63)
    for i, w in texts:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, 1 << 62), low if i is None else i)
    want = []
    for i, w in texts:
        gone = {k + o for k in range(len(w) - 12) for o in range(13) if i is not None and first[tuple(w[k:k + 13])] < i}
        text = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    got = substring.remove_repeats(corpus(rows), buckets=buckets, run_windows=run_windows).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == sorted(want)
    assert all(sum(s["end"] - s["first"] for s in r.removed) == r.n_removed for r in got)
    assert sum(r.n_removed > 0 for r in got) > 20


def test_empty(corpus):
    assert substring.remove_repeats(corpus([])).count() == 0
