"""Op 4: round trips against the tokenizer itself, and the files' layout."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from boutique.llm import token_store
from boutique.llm.token_store import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = random.Random(5)
    parts = ["a", "B", "'s", "'LL", "'", "it's", "don't", ".", ",", "!!!", "***", "—", "é", "É", "İ", "ß", "Σ", "1", "23", "½", " ", "\n", "\t", "̈", "<", "漢", "😀",
             "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "('s", "x-y", "''s", "\0", "\x1c", "\x85", "​", "ǅ", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [None, "", " "]
    encoder = Encoder(tokenizer_path())
    assert encoder.piecewise
    for chunk in (texts[:2000], [t for t in texts if "<|endoftext|>" not in (t or "")], texts):
        ids, offsets = encoder(pa.array(chunk, pa.string()))
        want = tokenizer.encode_batch([t or "" for t in chunk], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [w.ids for w in want]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_store, "_CACHE_PIECES", 3)
    texts = pa.array(["alpha beta gamma", "beta delta", "alpha epsilon zeta eta"])
    small, big = Encoder(tokenizer_path()), Encoder(tokenizer_path())
    for _ in range(3):
        assert [x.tolist() for x in small(texts)] == [x.tolist() for x in big(texts)]


def test_round_trip(spark, corpus, tokenizer, tmp_path):
    rows = [(7, "Hello, World! it's"), (3, None), (5, ""), (9, "x " * 50000), (-2, "été 漢字"), (4, "a"), (4, "a"), (4, "b"), (None, "null id")]
    path = str(tmp_path / "store")
    got = token_store.store_documents(corpus(rows), path).orderBy("start").collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), n, c) for i, n, c in want)
    assert [str(r.doc_id) for r in got] == [str(i) for i, _, _ in want]
    for r in got:
        assert r.start == at
        at += r.n_tokens
    store = spark.read.parquet(path)
    assert {r.doc_id for r in token_store.tokens_between(store, 3, 5).collect()} == {3, 4, 5}
    coded = []
    for f in (tmp_path / "store").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for p, c in columns.items() if p.startswith("ids"))
            assert ids.has_dictionary_page or "DELTA_BINARY_PACKED" in ids.encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
            coded.append(ids.has_dictionary_page)
    assert any(coded)


def test_empty(corpus):
    assert token_store.store_documents(corpus([])).count() == 0


def test_files_are_ordered_by_number(spark, tmp_path):
    """Beyond 100,000 files the names don't sort by number any more."""
    numbers = [3, 10001, 99999, 100000, 100001, 1000000]
    for k, number in enumerate(numbers):
        pq.write_table(pa.table({"doc_id": [k], "start_in_file": [0], "n_tokens": [10 ** k]}), tmp_path / f"part-{number:05d}-a-b-c000.zstd.parquet")
    store = spark.read.schema("doc_id long, start_in_file long, n_tokens long").parquet(str(tmp_path))
    got = {int(r.file.rsplit("part-", 1)[1].split("-")[0]): r.before for r in token_store.read_starts(store).collect()}
    assert got == {number: sum(10 ** j for j in range(k)) for k, number in enumerate(numbers)}
