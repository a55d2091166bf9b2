"""Small tables with every awkward case, and helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f long, k string, key long, shard int, score double, taken long, batch long, b int, size long"


def documents(spark, rows):
    """``rows`` of (doc_id, text[, lang[, source]]), with further columns whose names clash with the operators' own."""
    full = []
    for doc_id, text, *rest in rows:
        lang, source = (rest + [None, None])[:2]
        full.append((doc_id, text, lang, source, len(text or ""), 7, "k", 7, 7, 7.0, 7, 7, 7, 7))
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def prose(n, seed, vocabulary=400):
    return " ".join(words(n, seed, vocabulary))


def edited(text, places, seed=0):
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), places):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def awkward():
    """Null and empty texts, white space, single words, other scripts, a very long text, repeats of all of them."""
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "ONE"), (6, " "), (7, "Ünï cødé \U0001f600 文字"), (8, prose(60_000, 8)), (None, "no id here at all"), (None, None)]
    return rows + [(4, "one"), (8, prose(60_000, 8)), (None, "no id here at all")]
