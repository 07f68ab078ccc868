"""Op 7 against plain windows."""

import hashlib
import random
import re

import pytest

from boutique.llm import decontaminate
from tests.llm.conftest import words


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = terms(text)
    hit, found = set(), set()
    for item, t in items:
        iw = terms(t)
        n = min(13, len(iw))
        windows = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {str(item)} - {"None"}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture
def case(spark, corpus):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, rng.choice([1, 5, 13, 14, 30]), 400))) for k in range(20)]
    items += [(50, items[3][1]), (51, None), (52, "--"), (50, "w1 w2 w3"), (None, "w4 w5")]
    rows = []
    for i in range(150):
        text = words(rng, rng.randint(0, 200), 3000)
        if i % 3 == 0:
            own = rng.choice(items)[1] or ""
            text[5:5] = own.upper().split()[rng.randint(0, 2):]
        rows.append((i, ", ".join(text)))
    rows += [(500, None), (501, ""), (502, ""), (503, " ".join(words(rng, 50000)) + " " + (items[4][1])), (7, rows[7][1]), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 items", "2 n", "3 hash")
    return corpus(rows), rows, bench, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_equals_brute_force(case, block):
    docs, rows, bench, items = case
    got = decontaminate.decontaminate(docs, bench, block_windows=block).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(
        ((i, *brute(t, items)) for i, t in rows), key=key)
    kept = decontaminate.clean_documents(docs, bench, block_windows=block)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not brute(t, items)[-1])


def test_spans_are_cut_out(spark, corpus):
    passage = " ".join(f"p{k}" for k in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(corpus([(1, f"Before, {passage}. After"), (2, "clean"), (3, None)]), bench).collect()}
    assert got == {1: "Before, . After", 2: "clean", 3: None}


def test_empty_tables(spark, corpus, case):
    docs, rows, bench, _ = case
    assert decontaminate.decontaminate(corpus([]), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).filter("contaminated OR n_hit > 0").count() == 0
