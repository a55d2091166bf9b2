import hashlib
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from strandlake.llm import knn, minhash, mixing, queries, sharding, simhash, stages
from tests.llm import test_minhash, test_mixing, test_simhash
from tests.llm.common import awkward, documents, prose

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_operators(spark):
    """The pipeline's rows against each operator's own result on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = stages.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in knn.quality_scores(docs, labels).where("score >= 0.3").collect()}
    first = stages.quality(spark, docs, SF)
    assert first.columns == names and {r.doc_id for r in first.collect()} == kept and 0 < len(kept) < docs.count()
    second = stages.near_dedup(spark, first, SF)
    assert second.columns == names
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in minhash.near_duplicates(first).where("kept").collect()}
    third = stages.decontaminate(spark, second, SF)
    bad = {r.doc_id for r in simhash.leaks(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert third.columns == names and {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - bad
    fourth = stages.mix(spark, third, SF)
    taken = {r.doc_id: (r.taken > 0) + (r.taken > r["size"]) for r in mixing.mix(third).taken().collect()}
    assert fourth.columns == names and {i: n for i, n in fourth.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    last = sharding.shard_rows(fourth)
    assert last.count() == fourth.count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, run.collect())) == sorted(map(str, last.collect()))


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def mixed(rows):
    """How often each (id, text, source) comes: slots by the golden ratio, documents end to end in hash order, twice over."""
    sizes, out = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    target = test_mixing.fill(dict(sizes))
    for s in sizes:
        quota, at = round(target[s]), 0
        own = sorted((hashlib.md5(f"{i}|{t or ''}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s)
        for _ in range(2):
            for _, i, t in own:
                n = len((t or "").encode().split())
                out[i] += n > 0 and at < quota
                at += n
    return out


def test_pipeline_against_brute_force(spark):
    """All pairs for near duplicates, all windows for items, all rows for the mix, plain counts for the shards."""
    table = lambda name: [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    model = knn.fit(spark.read.parquet(f"{SF}/documents.parquet"), stages.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    docs = [d for d in table("documents") if model.scores([(d["text"] or "").encode()])[0] >= 0.3]
    kept = {i for i, _, c, k in test_minhash.brute([(d["doc_id"], d["text"]) for d in docs], 5, 80) if k}
    docs = [d for d in docs if d["doc_id"] in kept]
    bad = {d for d, _ in test_simhash.brute([(d["doc_id"], d["text"]) for d in docs], [(r["item_id"], r["text"]) for r in table("benchmark")])}
    docs = [d for d in docs if d["doc_id"] not in bad]
    times = mixed([(d["doc_id"], d["text"], d["source"]) for d in docs])
    want = Counter()
    for d in docs:
        data = (d["text"] or "").encode()
        want[d["doc_id"], len(data) + 1, zlib.crc32(data)] += times[d["doc_id"]]
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == +want
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null and empty texts, a very long one, repeated rows, null ids and clashing columns, through every stage."""
    known = [(1000 + i, prose(40, i) if i % 2 else "### $$$ %%% " * 10) for i in range(60)]
    documents(spark, known).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 900)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [*awkward(), (30, prose(60, 30)), (30, prose(60, 30)), (31, prose(10, 31) + " " + prose(30, 900))]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = Counter((r.doc_id, None if name == "sharding" else r.text) for r in out.collect())
        texts = Counter(rows)
        if name != "sharding":
            assert out.columns == docs.columns and set(got) <= set(texts)
        if name == "quality classifier":
            assert not {i for i, t in got if i in (1, 2, 3)} and got[30, prose(60, 30)] in (0, 2)
        elif name == "MinHash near-dedup":
            assert {got[i, t] for i, t in awkward()[:3]} == {1} and got[30, prose(60, 30)] == 1 and got[8, prose(60_000, 8)] == 1
        elif name == "benchmark decontamination":
            assert 31 not in {i for i, _ in got} and sum(got.values()) == len(rows) - 1
        elif name == "mixing sources to target weights":
            assert all(n <= 2 * texts[x] for x, n in got.items()) and sum(got.values()) > len(rows) / 2
        else:
            assert sum(got.values()) == len(rows)


def test_no_usable_label_is_an_error(spark, tmp_path):
    documents(spark, [(1, "some text")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError, match="no labelled text"):
        stages.quality(spark, documents(spark, [(1, "some text")]), str(tmp_path))
    assert stages.quality(spark, documents(spark, []), str(tmp_path)).collect() == []
