"""Operator 9, language identification: mixtures of languages by expectation-maximisation.

Learning: byte trigrams of lower-cased words (with a border byte on both sides) are counted
per language in ``BUCKETS`` hash buckets over all learning texts, one compact row per task,
language and slice, summed in Spark. They give smoothed log-probabilities per language, a
table of a fixed size per language, which is broadcast.

Prediction: a document is a mixture of languages in unknown proportions. Each word has a
likelihood under each language (the product of its trigrams' probabilities); EM estimates
the proportions, weighing words by their trigrams. The set of languages minimises the
penalised likelihood: starting from all languages, the one of the smallest proportion is
dropped while that improves -2 ln L + (languages - 1) * ln(words). The prediction is the
largest proportion in the chosen set, which is also the score.

Defined cases: null texts and texts without a letter give `und` with score 0, as does a
learning set without rows; ties go to the smaller language name; other empty-looking texts
(letters outside any word can't occur) are scored like all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import Words, byte_table, segment_sums, slices
from boutique.llm.frames import id_remainder

BUCKETS = 1 << 15
SLICES = 8
ROUNDS = 12
UNKNOWN = "und"
#: Languages are few; the broadcast table takes 128 KB for each.
MOST_LANGUAGES = 1000

LETTERS = byte_table(words=b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", fold_ascii=True)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # float32 (BUCKETS, languages)


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by word) of the trigrams centred on each byte of each word."""
    folded = LETTERS[words.buf].astype(np.uint32)
    n = len(folded)
    left = np.zeros(n, np.uint32)
    right = np.zeros(n, np.uint32)
    left[1:], right[:-1] = folded[:-1], folded[1:]
    left[words.starts] = 0
    right[words.ends - 1] = 0
    grams = (left * np.uint32(0x9E3779B1)) ^ (folded * np.uint32(0x85EBCA6B)) ^ (right * np.uint32(0xC2B2AE35))
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    buckets = (grams >> np.uint32(32 - BUCKETS.bit_length() + 1))[folded > 0].astype(np.int32)
    return buckets, np.concatenate([[0], np.cumsum(words.ends - words.starts)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), LETTERS, hashed=False)
            buckets, word_offsets = _trigrams(words)
            by_row = word_offsets[words.offsets]
            langs, index = np.unique(np.asarray(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            rows = np.repeat(index, np.diff(by_row))
            for k, lang in enumerate(langs.tolist()):
                own = buckets if len(langs) == 1 else buckets[rows == k]
                counts[lang] = counts.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
    for lang, c in counts.items():
        yield pa.RecordBatch.from_pydict({
            "lang": [lang] * SLICES, "slice": pa.array(range(SLICES), pa.int32()),
            "counts": [x.astype(np.int64).tobytes() for x in c.reshape(SLICES, -1)]})


def _add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, last = 0, None
    for batch in group:
        for c in batch.column("counts"):
            total = total + np.frombuffer(c.as_buffer(), np.int64)
        last = batch
    yield pa.RecordBatch.from_pydict({"lang": [last.column("lang")[0].as_py()], "slice": pa.array([last.column("slice")[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def train(documents: DataFrame) -> Model:
    """Model of the (text, lang) rows given; rows without lang or text are left out."""
    schema = "lang string, slice int, counts binary"
    rows = (documents.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
            .mapInArrow(_count, schema).groupBy("lang", "slice").applyInArrow(_add, schema))
    found = rows.limit(MOST_LANGUAGES * SLICES + 1).collect()
    if len(found) > MOST_LANGUAGES * SLICES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((len(languages), SLICES, BUCKETS // SLICES))
    for r in found:
        counts[languages.index(r["lang"]), r["slice"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.reshape(len(languages), BUCKETS)
    smooth = counts + 0.5
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else smooth
    return Model(languages, np.ascontiguousarray(logs.T.astype(np.float32)))


def _mixture(lik: np.ndarray, weights: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document over its ``allowed`` languages.
    ``lik``: words x languages, relative to each word's best; ``weights``: of the words."""
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(counts)), counts)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    mass = np.maximum(segment_sums(weights, offsets), 1e-9)
    for _ in range(ROUNDS):
        part = lik * share[rows]
        part *= (weights / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        share = np.stack([segment_sums(part[:, k], offsets) for k in range(lik.shape[1])], axis=1) / mass[:, None]
    fit = np.log(np.maximum(np.einsum("ij,ij->i", lik, share[rows]), 1e-30))
    return share, segment_sums(fit, offsets)


def proportions(model: Model, words: Words) -> np.ndarray:
    """Documents x languages: proportions over the language set chosen for each."""
    buckets, word_offsets = _trigrams(words)
    n_langs = len(model.languages)
    n = len(words.starts)
    if not n:
        return np.zeros((len(words.offsets) - 1, n_langs))
    logs = np.stack([segment_sums(model.logs[:, k][buckets], word_offsets) for k in range(n_langs)], axis=1)
    lik = np.exp(logs - logs.max(axis=1, keepdims=True))
    weights = np.diff(word_offsets).astype(np.float64)
    allowed = np.ones((len(words.offsets) - 1, n_langs), bool)
    share, fit = _mixture(lik, weights, words.offsets, allowed)
    best = share.copy()
    # One language alone can't fit better than all together: where all together gain less
    # than one extra language costs, the best single language is the answer.
    single = np.stack([segment_sums(np.log(np.maximum(lik[:, k], 1e-30)), words.offsets) for k in range(n_langs)], axis=1)
    top, cost = single.argmax(axis=1), np.log(np.maximum(words.counts, 2))
    alone = 2 * (fit - single.max(axis=1)) <= cost
    best[alone] = np.eye(n_langs)[top[alone]]
    open_rows = np.flatnonzero(~alone & (words.counts > 0))
    if len(open_rows):
        best[open_rows] = _eliminate(lik, weights, words.offsets, open_rows, share[open_rows], fit[open_rows])
    best[words.counts == 0] = 0
    return best


def _eliminate(lik, weights, offsets, rows, share, fit) -> np.ndarray:
    """Backward elimination on the documents ``rows``; the set of least penalised likelihood."""
    picked = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
    counts = (offsets[1:] - offsets[:-1])[rows]
    own = np.concatenate([[0], np.cumsum(counts)])
    lik, weights = lik[picked], weights[picked]
    n_langs = lik.shape[1]
    price = np.log(np.maximum(counts, 2))
    allowed = np.ones((len(rows), n_langs), bool)
    best, least = share, -2 * fit + (n_langs - 1) * price
    for left in range(n_langs - 1, 0, -1):
        allowed = allowed.copy()
        allowed[np.arange(len(rows)), np.where(allowed, share, np.inf).argmin(axis=1)] = False
        share, fit = _mixture(lik, weights, own, allowed)
        cost = -2 * fit + (left - 1) * price
        better = cost < least
        best = np.where(better[:, None], share, best)
        least = np.minimum(cost, least)
    return best


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.languages
        mixture_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                lettered = np.asarray(part.column("lettered").fill_null(False))
                shares = proportions(model.value, Words(part.column("text"), LETTERS, hashed=False)) if names else np.zeros((part.num_rows, 0))
                known = lettered & (shares.sum(axis=1) > 0)
                top = shares.argmax(axis=1) if names else np.zeros(part.num_rows, int)
                pred = [names[t] if k else UNKNOWN for t, k in zip(top.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(shares.max(axis=1, initial=0), 0, 1), 0.0)
                sets = [[{"lang": names[j], "share": float(s[j])} for j in np.flatnonzero(s > 1e-3)] if k else [] for s, k in zip(shares, known, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, mixture_type)],
                    names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the estimated mixture of every row of (doc_id, text)."""
    rows = documents.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def predict_documents(documents: DataFrame) -> DataFrame:
    """Learn from the documents with crc32(doc_id) mod 3 not 1, predict all."""
    held_out = id_remainder("doc_id", 3) == 1
    model = train(documents.filter(~held_out & F.col("doc_id").isNotNull()))
    return identify(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")
