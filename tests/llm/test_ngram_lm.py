import math
from collections import Counter

import pytest

from strandlake.llm import ngram_lm
from tests.llm.common import awkward, documents, prose


def brute(texts):
    docs = [(t or "").encode().lower().split() for t in texts]
    count = lambda ws, n: Counter(tuple(w[i : i + n]) for w in ws for i in range(len(w) - n + 1))
    whole, total, out = [None, *(count(docs, n) for n in (1, 2, 3))], sum(map(len, docs)), []
    for w in docs:
        rest = [None, *(whole[n] - Counter() for n in (1, 2, 3))]
        for n in (1, 2, 3):
            rest[n] = Counter(whole[n])
            rest[n].subtract(count([w], n))
        others, s = max(total - len(w), 1), 0.0
        for i in range(len(w)):
            n, factor = min(3, i + 1), 1.0
            while n > 1 and rest[n][tuple(w[i - n + 1 : i + 1])] <= 0:
                n, factor = n - 1, factor * 0.4
            c = rest[n][tuple(w[i - n + 1 : i + 1])]
            p = c / rest[n - 1][tuple(w[i - n + 1 : i])] if n > 1 else (c if c > 0 else 0.4) / others
            s += math.log2(factor * p)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("batch", [50, 1_000_000])
def test_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(ngram_lm, "BATCH_WORDS", batch)
    monkeypatch.setattr(ngram_lm, "PART_KEYS", 500)
    texts = [prose(5 + k, k, 30) for k in range(60)] + [prose(20, 1, 30)] * 5 + ["a b c", "A B  c", "alone", None, "", " "]
    rows = list(enumerate(texts))
    got = sorted((r.doc_id, r.n_words, round(r.log2_score, 6)) for r in ngram_lm.backoff_scores(documents(spark, rows)).collect())
    assert got == [(i, n, round(s, 6)) for i, (n, s) in enumerate(brute(texts))]


def test_awkward_and_empty(spark):
    out = ngram_lm.backoff_scores(documents(spark, awkward())).collect()
    assert len(out) == len(awkward()) and all(math.isfinite(r.log2_score) for r in out)
    assert sorted((r.n_words, r.log2_score) for r in out)[:4] == [(0, 0.0)] * 4
    assert ngram_lm.backoff_scores(documents(spark, [])).collect() == []
    assert ngram_lm.backoff_scores(documents(spark, [(1, None)])).collect()[0].n_words == 0


def test_keys_stay_apart_at_any_number_of_partitions():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 100_000).astype(np.uint64) * np.uint64(2)
    for parts in (1, 7, 1000, 2**24):
        keys, low = ngram_lm.placed(h, parts)
        assert len(np.unique(keys)) == len(np.unique(h)) and int((keys >> np.uint64(low)).max()) < parts
    x = np.sort(h[:100])
    assert (ngram_lm.ungaps(ngram_lm.gaps(x)) == x).all()
