from collections import defaultdict

from strandlake.llm import mixing, stages
from tests.llm.common import awkward, documents, prose

WEIGHTS = (3.0, 1.0, 2.0)


def fill(sizes):
    """Targets by resharing what is over, again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def rows_of(spark):
    rows = [(i, prose(1 + (i * 37) % 300, i), None, f"s{i % 5}" if i % 7 else None) for i in range(300)]
    rows += [(1000 + i, prose(900, 1000 + i), None, "big") for i in range(40)] + [(i, t, None, "odd") for i, t in awkward()]
    return rows


def test_targets_and_taken(spark):
    rows = rows_of(spark)
    out = mixing.mix(documents(spark, rows)).taken().collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    want = fill(dict(sizes))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_agree_in_any_order(spark):
    rows = rows_of(spark)
    a = mixing.mix(documents(spark, rows)).taken().select("doc_id", "size", "taken").collect()
    b = mixing.mix(documents(spark, rows[::-1]).repartition(5)).taken().select("doc_id", "size", "taken").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_every_stretch_of_the_schedule_is_mixed(spark):
    rows = [(i, prose(2048, i % 50), None, f"s{i % 3}") for i in range(150)]
    m = mixing.mix(documents(spark, rows))
    order = [r.source for r in m.pieces.where("position is not null").groupBy("position", "source").count().orderBy("position").collect()]
    shares = {s: order.count(s) / len(order) for s in set(order)}
    for k in range(0, len(order) - 30, 10):
        part = order[k : k + 30]
        assert all(abs(part.count(s) - 30 * shares[s]) <= 4 for s in shares)


def test_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).taken().collect() == []
    out = mixing.mix(documents(spark, [(1, None), (2, " ")])).taken().collect()
    assert [(r.taken, r.target) for r in out] == [(0, 0.0)] * 2


def test_stage_repeats_whole_documents(spark):
    """Repeated rows, rows that agree in id and text only, and one id and text in two sources."""
    rows = [(i, prose(100, i), "en", f"s{i % 4}") for i in range(80)] + [(5, prose(100, 5), "en", "s1")] * 9 + [(5, prose(100, 5), "de", "s1")] * 10
    rows += [(5, prose(100, 5), "en", "s2"), (6, None, "en", "s2"), (7, " ", None, None), (None, prose(30, 7), None, None)] * 2
    docs = documents(spark, rows)
    out = stages.mix(spark, docs, "")
    assert out.columns == docs.columns
    taken = mixing.mix(docs).taken().collect()
    want, got = defaultdict(int), defaultdict(int)
    for r in taken:
        want[r.doc_id, r.source] += 2 if r.taken > r["size"] else int(r.taken > 0)
    langs = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
        langs[r.doc_id, r.source, r.lang] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert abs(langs[5, "s1", "en"] - langs[5, "s1", "de"]) <= 4


def test_stage_follows_the_schedule(spark):
    """Rows come out in the order of their stretches of the schedule, so each run of rows holds the sources in their shares."""
    rows = [(i, prose(200 + i % 300, i % 50), None, f"s{i % 3}") for i in range(600)]
    docs = documents(spark, rows)
    place = {r.doc_id: r.position for r in mixing.mix(docs).taken().collect()}
    out = [r.doc_id for r in stages.mix(spark, docs, "").collect()]
    first = list(dict.fromkeys(out))
    stretch = [place[i] for i in first]
    assert sum(a > b for a, b in zip(stretch, stretch[1:])) <= len(stretch) // 20
    share = lambda ids: sum(i % 3 == 0 for i in ids) / len(ids)
    assert all(abs(share(out[k : k + 120]) - share(out)) < 0.15 for k in range(0, len(out) - 120, 60))


def test_bisected_bounds_and_ranges_agree(spark, monkeypatch):
    """A hot source, repeated rows and a source of one row: the same rows either way, one source's stretch by stretch in order of hashes."""
    rows = [(i, prose(30 + i % 200, i % 70), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(9, prose(80, 9), "en", "hot")] * 30 + [(1000, prose(50, 1), None, None)]
    docs = documents(spark, rows)
    a = stages.mix(spark, docs, "").collect()
    monkeypatch.setattr(mixing, "BOUNDS", 0)
    b = stages.mix(spark, docs, "").collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.text)
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) > 400
    assert [key(r) for r in a] == [key(r) for r in b]


def test_bisection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 8, 1000):
        bounds = [3 * i for i in range(n)]
        rows = spark.createDataFrame([(bounds, x) for x in range(-2, 3 * n + 4)], "b array<long>, x long")
        got = rows.select("x", mixing._last_not_above(F.col("b"), F.col("x")).alias("i")).collect()
        assert all(r.i == max(1, sum(b <= r.x for b in bounds)) for r in got)
