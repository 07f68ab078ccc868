"""Op 9: languages by made-up vocabularies."""

import math
import random

import numpy as np
import pyarrow as pa

from boutique.llm import language
from boutique.llm.arrays import Words

SYLLABLES = {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["ßel", "gru", "ön", "tz", "ver"], "cc": ["ñi", "ción", "el", "os", "qu"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_predicts_and_mixes(spark, corpus):
    rng = random.Random(9)
    rows = [(i, text(rng, lang := "abc"[i % 3] * 2, rng.randint(3, 120)), lang) for i in range(300)]
    rows += [(i, None, "aa") for i in range(300, 303)] + [(304, "", "bb"), (305, "12 %% 3", "aa"), (306, text(rng, "aa", 30), None)]
    rows += [(310, (a := text(rng, "aa", 90)) + " " + (b := text(rng, "bb", 30)), None), (311, text(rng, "cc", 30000), "cc"), (1, rows[1][1], rows[1][2]), (None, text(rng, "bb", 20), "bb")]
    got = language.predict_documents(corpus(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:300])
    assert [by_id[i].lang_pred for i in (300, 304, 305, 306, 311, None)] == ["und", "und", "und", "aa", "cc", "bb"]
    assert by_id[300].score == 0 and all(0 <= r.score <= 1 for r in got)
    mixture = {m["lang"]: m["share"] for m in by_id[310].mixture}
    share = len(a.encode()) / len((a + b).encode())  # words weigh as much as their trigrams
    assert set(mixture) == {"aa", "bb"} and abs(mixture["aa"] - share) < 0.05 and by_id[310].lang_pred == "aa"


def test_nothing_to_learn(corpus):
    assert {r.lang_pred for r in language.predict_documents(corpus([(1, "abc"), (2, None)])).collect()} == {"und"}
    assert language.predict_documents(corpus([])).count() == 0


def plain_proportions(logs, grams_of_words):
    """One document: EM over all languages by loops, then backward elimination by penalised
    likelihood, a single language where that is no worse."""
    n = logs.shape[1]
    words = [[sum(float(logs[g, k]) for g in grams) for k in range(n)] for grams in grams_of_words]
    lik = [[math.exp(x - max(w)) for x in w] for w in words]
    weight = [len(g) for g in grams_of_words]

    def em(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(n)]
        for _ in range(language.ROUNDS):
            new = [0.0] * n
            for w, row in zip(weight, lik):
                total = max(sum(a * b for a, b in zip(row, share)), 1e-30)
                for k in range(n):
                    new[k] += w * row[k] * share[k] / total
            share = [x / max(sum(weight), 1e-9) for x in new]
        return share, sum(math.log(max(sum(a * b for a, b in zip(row, share)), 1e-30)) for row in lik)

    price = math.log(max(len(lik), 2))
    share, fit = em(set(range(n)))
    single = [sum(math.log(max(row[k], 1e-30)) for row in lik) for k in range(n)]
    if 2 * (fit - max(single)) <= price:
        return [float(k == single.index(max(single))) for k in range(n)]
    best, least, allowed = share, -2 * fit + (n - 1) * price, set(range(n))
    while len(allowed) > 1:
        allowed = allowed - {min(allowed, key=lambda k: share[k])}
        share, fit = em(allowed)
        if -2 * fit + (len(allowed) - 1) * price < least:
            best, least = share, -2 * fit + (len(allowed) - 1) * price
    return best


def test_mixtures_against_plain_em():
    """Log-likelihoods, proportions and the chosen set, document by document."""
    rng = random.Random(3)
    names = sorted(SYLLABLES) + ["dd"]
    SYLLABLES["dd"] = ["ka", "to", "gru", "ön", "zu"]  # half of aa, half of bb
    counts = np.zeros((4, language.BUCKETS))
    for k, lang in enumerate(names):
        buckets, _ = language._trigrams(Words(pa.array([text(rng, lang, 3000)]), language.LETTERS, hashed=False))
        np.add.at(counts[k], buckets, 1)
    smooth = counts + 0.5
    model = language.Model(names, np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)))
    docs = [" ".join(text(rng, rng.choice(names), rng.randint(1, 25)) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(40)] + ["ka", "", "12 %"]
    words = Words(pa.array(docs), language.LETTERS, hashed=False)
    got = language.proportions(model, words)
    buckets, offsets = language._trigrams(words)
    sets = set()
    for d in range(len(docs)):
        grams = [buckets[offsets[w]:offsets[w + 1]].tolist() for w in range(words.offsets[d], words.offsets[d + 1])]
        want = plain_proportions(model.logs, grams) if grams else [0.0] * 4
        assert np.allclose(got[d], want, atol=1e-4), docs[d]
        sets.add(tuple(np.flatnonzero(got[d] > 1e-3).tolist()))
    del SYLLABLES["dd"]
    assert len(sets) >= 6


def test_trigram_counts():
    """Buckets are a function of the letters' bytes: equal words count alike wherever they stand."""
    a = language._trigrams(Words(pa.array(["Kato gruön, kato"]), language.LETTERS, hashed=False))
    b = language._trigrams(Words(pa.array(["kato", "x", "gruön", "KATO"]), language.LETTERS, hashed=False))
    first = a[0][a[1][0]:a[1][1]].tolist()
    assert first == a[0][a[1][2]:a[1][3]].tolist() == b[0][b[1][0]:b[1][1]].tolist() == b[0][b[1][3]:b[1][4]].tolist()
    assert a[0][a[1][1]:a[1][2]].tolist() == b[0][b[1][2]:b[1][3]].tolist()
