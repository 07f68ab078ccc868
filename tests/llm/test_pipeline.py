"""The pipeline over a small folder, each stage against its operator's plain meaning."""

import re

import corpus_pipeline
from boutique.llm import frames, near_dups, toxicity
from tests.llm.test_decontaminate import brute


def test_stages(spark, sf_small):
    docs = frames.table(spark, sf_small, "documents")
    columns = docs.columns
    items = [tuple(r) for r in frames.table(spark, sf_small, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        given = docs
        docs = frames.stored(stage(spark, docs, sf_small), f"test-{name}")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name != "token_ids":
            assert docs.columns == columns and {tuple(r) for r in after} <= {tuple(r) for r in before.values()}
        if name == "toxicity":
            scores = toxicity.score(given, toxicity.fitted(given, frames.table(spark, sf_small, "labels")))
            assert sorted(ids) == sorted(r.doc_id for r in scores.filter("score < 0.5").select("row.doc_id").collect())
        elif name == "near_duplicates":
            classes = near_dups.near_duplicates(given).collect()
            assert sorted(ids) == sorted({r.class_id for r in classes}) and len(ids) < len(before)
        elif name == "decontamination":
            assert sorted(ids) == sorted(i for i, r in before.items() if not brute(r.text, items)[-1])
        elif name == "mixing":
            sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
            assert max(ids.count(i) for i in set(ids)) <= 3 and sum(sizes.values()) * 0.8 < sum(sizes[i] for i in ids) < sum(sizes.values()) * 1.2
        else:
            assert sorted(ids) == sorted(r.doc_id for r in given.collect())
            assert sorted(r.start for r in after)[0] == 0 and sum(r.n_tokens for r in after) == max(r.start + r.n_tokens for r in after)


def test_run(spark, sf_small):
    rows = sorted(corpus_pipeline.QUERIES["pipeline"](spark, sf_small).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert len(rows) > 50 and ids == sorted(ids)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
