import numpy as np
import pytest

from pyspark.sql import functions as F

from strandlake.llm import minhash
from strandlake.llm.components import components
from strandlake.llm.skew import spread
from strandlake.scratch import Scratch
from tests.llm.common import awkward, documents, edited, prose


def brute(rows, shingle, percent):
    """(doc_id, n, component, kept) by comparing all pairs; ids are not null and don't repeat."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((i, len(s), label[i], label[i] == i) for i, s in sets.items())


def cloud(n, seed, size=150):
    """Near copies of one text, edited more and more: chains of links, and members that are near no other."""
    base = prose(size, seed)
    return [edited(base, k % 19, seed * 1000 + k) for k in range(n)]


@pytest.mark.parametrize("shingle", [2, 5])
def test_brute_force(spark, shingle):
    texts = cloud(120, 1) + cloud(40, 2) + [prose(80, 100 + k) for k in range(40)] + ["same text here"] * 30 + ["", None, "x"]
    rows = list(enumerate(texts, 10))
    got = [tuple(r) for r in minhash.near_duplicates(documents(spark, rows), shingle, 80).collect()]
    assert sorted(got) == brute(rows, shingle, 80)


def test_awkward(spark):
    got = [tuple(r) for r in minhash.near_duplicates(documents(spark, awkward()), 2, 80).collect()]
    assert len(got) == len(awkward())
    by = {}
    for i, n, c, k in got:
        by.setdefault(i, []).append((n, c, k))
    assert by[1] == by[2] or by[1][0][0] == by[2][0][0] == 0
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] * 2 and by[5] == [(1, 4, False)] and by[6] == [(1, 6, True)]
    assert [x[1:] for x in by[8]] == [(8, True)] * 2
    assert sorted(by[None]) == [(0, None, True), (4, None, True), (4, None, True)]


def test_null_ids_give_way_to_others(spark):
    got = {r[0]: (r[2], r[3]) for r in minhash.near_duplicates(documents(spark, [(None, "a b c d"), (9, "a b c d")]), 2, 80).collect()}
    assert got == {None: (9, False), 9: (9, True)}


def test_empty(spark):
    assert minhash.near_duplicates(documents(spark, []), 2, 80).collect() == []
    assert minhash.one_of_each(documents(spark, [])).collect() == []


def test_one_of_each(spark):
    base = prose(200, 5)
    rows = [(1, base), (2, edited(base, 2, 1)), (3, prose(200, 6)), (4, base), (5, None), (6, "")]
    out = minhash.one_of_each(documents(spark, rows))
    assert out.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6]


def test_one_of_each_with_repeated_ids(spark):
    base, other = prose(200, 5), prose(200, 6)
    rows = [(1, base), (1, base), (1, other), (2, base), (3, other), (7, None), (7, ""), (None, "a b c d e f"), (None, "a b c d e f")]
    out = [(r.doc_id, r.text) for r in minhash.one_of_each(documents(spark, rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, base), (1, other), (7, None), (7, ""), (None, "a b c d e f")], key=str)


def test_tiles_compare_what_hubs_leave(spark):
    """A tile finds a link that no hub has, once for each two components."""
    import pyarrow as pa
    import zstandard

    texts = [prose(100, 70 + k // 2).encode() for k in range(4)]
    sets = [minhash.shingle_set(x, 2) for x in texts]
    f, key = [1, 2, 3, 4], 5
    bands = [[key] + [100 + i] * 31 for i in range(4)]
    rows = {"key": [key] * 8, "f": f * 2, "c": f * 2, "out": [False, True, True, True] * 2, "left": [True] * 4 + [False] * 4, "bands": bands * 2}
    rows |= {"n": [len(x) for x in sets] * 2, "sigs": [minhash.packed(minhash.minima(x)).tolist() for x in sets] * 2, "data": [zstandard.compress(x) for x in texts] * 2}
    rows["left"][0] = False
    met = minhash._met(80)(pa.table(rows))
    assert set(met.column("f").to_pylist()) == {1, 2, 3, 4}
    got = minhash._tile(80, 2)(met).to_pydict()
    assert {frozenset(x) for x in zip(got["a"], got["b"])} == {frozenset((1, 2)), frozenset((3, 4))}


def test_estimates_keep_far_texts_out_of_tiles(spark):
    """Of nodes that share a band and no more, none goes on to be compared by its text."""
    import pyarrow as pa

    sets = [minhash.shingle_set(prose(100, 90 + k).encode(), 2) for k in range(6)]
    bands = [[5] + [100 + i] * 31 for i in range(6)]
    rows = {"key": [5] * 12, "f": list(range(6)) * 2, "c": list(range(6)) * 2, "out": [False, *[True] * 5] * 2, "left": [True] * 6 + [False] * 6, "bands": bands * 2}
    rows |= {"n": [len(x) for x in sets] * 2, "sigs": [minhash.packed(minhash.minima(x)).tolist() for x in sets] * 2}
    assert len(minhash._met(80)(pa.table(rows))) == 0


def test_estimate_is_close(spark):
    base = prose(400, 9)
    near = edited(base, 12, 3)
    a, b = (minhash.shingle_set(t.encode(), 2) for t in (base, near))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pa_, pb = (minhash.packed(minhash.minima(x)) for x in (a, b))
    x = spark.createDataFrame([tuple(map(int, pa_))], ", ".join(f"hs{i} long" for i in range(minhash.LONGS)))
    y = spark.createDataFrame([tuple(map(int, pb))], ", ".join(f"s{i} long" for i in range(minhash.LONGS)))
    got = x.crossJoin(y).select(minhash.estimate("h", "")).first()[0]
    assert abs(got - true) < 0.15


def test_rows_without_an_id_or_with_the_same_one_stay_apart(spark):
    """Different texts under one id, null or not: a text for each node, not for each pair of rows."""
    texts = [prose(12, 500 + k) for k in range(600)] + [edited(prose(80, 3), 1, k) for k in range(40)]
    rows = [(None, t) for t in texts] + [(7, t + " more") for t in texts]
    docs = documents(spark, rows)
    scratch = Scratch(spark)
    nodes = docs.select(minhash._row(F.col("doc_id"), F.col("text")).alias("row"), F.xxhash64("text").alias("f"), F.lit(1).alias("copies"))
    assert minhash._texts(nodes, nodes.select("f"), docs, scratch).count() == len(rows)
    got = minhash.near_duplicates(docs, 2, 80).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(7, 7)}


def test_generated_methods_stay_small(spark, monkeypatch, capsys):
    """A method of 42 aggregates had 5,031 bytes: the JVM took seconds to compile it."""
    import re

    found, save = {}, Scratch.save

    def seen(self, df, name):
        capsys.readouterr()
        df.explain(mode="codegen")
        found[name] = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", seen)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else what will be generated isn't known before it runs
    try:
        minhash.near_duplicates(documents(spark, list(enumerate(cloud(20, 1)))), 2, 80)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(found.values()) > 0 and "nodes" in found
    assert {k: v for k, v in found.items() if v > 4500} == {}, found


def test_spread_is_a_join(spark):
    rows = spark.createDataFrame([(k % 3 if k % 2 else 99, k) for k in range(300)] + [(None, -1)], "key long, x long")
    values = rows.groupBy("key").count().withColumn("y", F.col("key") * 2).where("key <> 2")
    want = sorted(rows.join(values.drop("count"), "key").collect())
    assert sorted(spread(rows, values, "key", "count").collect()) == want


def test_components_of_a_star_and_a_path(spark):
    edges = [(5, 100 + k) for k in range(400)] + [(k, k + 1) for k in range(1000, 1040)] + [(3, 3)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {5: 5} | {100 + k: 5 for k in range(400)} | {k: 1000 for k in range(1000, 1041)}
