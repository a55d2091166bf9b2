from collections import Counter

import numpy as np

from strandlake.llm import simhash
from strandlake.llm import text as tx
from tests.llm.common import awkward, documents, edited, prose


def similar(a, b):
    a, b = Counter(a.tolist()), Counter(b.tolist())
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    """Every window of every item's size against the item, by weighted similarity."""
    out = set()
    for d, t in docs:
        w = simhash.words((t or "").encode())
        for i, u in items:
            v = simhash.words((u or "").encode())
            if not len(v) or not len(w):
                continue
            bag = tx.ngrams(v, 5)
            if not np.isin(tx.ngrams(w, min(5, len(v))), bag).any() and len(w) >= len(v):
                continue
            if any(similar(tx.ngrams(w[s : s + len(v)], 5), bag) >= 0.8 for s in range(max(1, len(w) - len(v) + 1))):
                out.add((d, i))
    return out


def test_brute_force(spark):
    items = [(k, prose(14 + k % 30, 500 + k)) for k in range(40)] + [(90, "two words"), (91, None), (92, ""), (93, prose(20, 501)), (94, prose(20, 501))]
    docs = [(k, prose(80, k)) for k in range(20)]
    for k in range(40):
        item = items[k][1]
        dose = edited(item, k % 4, k) if k % 4 else item.upper().replace(" ", ", ", 3)
        docs.append((100 + k, f"{prose(30, 900 + k)} {dose} {prose(30, 950 + k)}"))
    docs += [(200, items[3][1]), (201, " ".join(items[4][1].split()[:-1])), (202, "it has two words in it"), (203, "two words"), (204, prose(20, 501))]
    got = simhash.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and all(0.8 <= r.similarity <= 1 for r in got)
    assert {r.start_word for r in got if r.doc_id == 100} == {30}


def flipped(code, places):
    bits = np.unpackbits(code.view(np.uint8))
    bits[places] ^= 1
    return np.packbits(bits).view(np.uint64)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = simhash.Index([(k, prose(30, k).encode()) for k in range(60)])
    codes = np.stack([flipped(index.codes[int(rng.integers(60))], rng.choice(192, int(rng.integers(0, 70)), replace=False)) for _ in range(300)])
    # the worst case: the radius spread evenly over the blocks
    codes[0] = flipped(index.codes[7], [16 * k + j for k in range(12) for j in range(4)][:47])
    apart = np.bitwise_count(codes[:, None, :] ^ index.codes[None, :, :]).sum(axis=2)
    want = set(zip(*(x.tolist() for x in np.nonzero(apart <= simhash.RADIUS))))
    assert set(zip(*(x.tolist() for x in index.within(codes, 30)))) == want and (0, 7) in want


def test_index_leaves_most_items_aside():
    index = simhash.Index([(k, prose(30, k, 5000).encode()) for k in range(400)])
    others = np.stack([simhash.simhash(tx.ngrams(simhash.words(prose(30, 9000 + k, 5000).encode()), 5)) for k in range(200)])
    assert len(index.met(others)[0]) < 0.15 * 400 * 200


def test_radius_holds_what_the_threshold_asks():
    """Windows at the threshold are within the radius: edits of one word, which change five shingles of many."""
    far = []
    for k in range(300):
        text = prose(40 + k % 20, k)
        w = text.split()
        w[k % len(w)] = "other"
        a, b = (tx.ngrams(simhash.words(x.encode()), 5) for x in (text, " ".join(w)))
        if similar(a, b) >= 0.8:
            far.append(int(np.bitwise_count(simhash.simhash(a) ^ simhash.simhash(b)).sum()))
    assert len(far) > 50 and max(far) <= simhash.RADIUS


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, prose(30, 8_000)), (2, None)], "item_id long, text string")
    rows = [*awkward(), (None, prose(30, 8_000)), (5, prose(30, 8_000)), (5, prose(30, 8_000))]
    got = sorted((str(r.doc_id), r.item_id) for r in simhash.leaks(documents(spark, rows), bench).collect())
    assert got == [("5", 1), ("5", 1), ("None", 1)]
    assert simhash.leaks(documents(spark, []), bench).collect() == []
    assert simhash.leaks(documents(spark, rows), bench.where("false")).collect() == []
    clean = simhash.without_leaks(documents(spark, rows), bench)
    assert clean.columns == documents(spark, []).columns and clean.count() == len(awkward())


def test_items_beyond_one_pass(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ITEMS", 3)
    bench = spark.createDataFrame([(k, prose(20, 700 + k)) for k in range(10)], "item_id long, text string")
    got = simhash.leaks(documents(spark, [(k, prose(20, 700 + k)) for k in range(10)]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(10)]
