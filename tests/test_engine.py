"""The sequence engine on a small cohort, against plain Python and its own other ways."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators import chains, edits, joins, kmers, training
from strandlake.operators.cohort import Cohort
from strandlake.sources import archive, codec, fasta, fasta_scan, tables
from strandlake.streaming.serve import serve

Q = 1024
TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def rc(s):
    return s.translate(TURN)[::-1]


def dna(n, seed, letters="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def substituted(s, every, seed):
    r, out = random.Random(seed), list(s)
    for k in range(r.randrange(every), len(s), every):
        if out[k] in "ACGT":
            out[k] = "ACGT"["ACGT".index(out[k]) - 1]
    return "".join(out)


REF = {"chrA": dna(9000, 1), "chrB": dna(3000, 2) + "N" * 300 + dna(2700, 3)}


def assembly(seed):
    a, b = REF["chrA"], REF["chrB"]
    return {
        "ctg1": substituted(a[: 5000 + seed], 211, seed),
        "ctg2": rc(substituted(b, 307, seed + 50)),
        "ctg3": a[1000:2000] + rc(a[2000:3000]) + a[3000:4000],
        "ctg4": dna(1500, 100 + seed) + "N" * 40 + "ACGTTGCAAC" * 30 + dna(50, 7, "RYKM"),
        **{f"short{n}": dna(n, n + seed) for n in (1, 5, 22, 23, 1023, 1024, 1025)},
        "zero": "",
    }


ASM = {"y1_P1.1": assembly(1), "y1_P1.2": assembly(2), "y1_P2.1": assembly(3), "y1_P3.1": assembly(4)}
LOWER = [(0, 3), (1000, 60), (5000, 2500), (9000, 1)]


def contigs(spark, cohort):
    rows = [(a, i, f"{n} of {a}", s, 60) for a, c in cohort.items() for i, (n, s) in enumerate(c.items())]
    return spark.createDataFrame(rows, "assembly string, order long, header string, seq string, line_width int")


@pytest.fixture(scope="module")
def ref(spark):
    return Cohort.build(contigs(spark, {"ref": REF}), Q)


@pytest.fixture(scope="module")
def cohort(spark):
    runs = spark.createDataFrame([(a, s, n) for a in ASM for s, n in LOWER], "assembly string, start long, len long")
    return Cohort.build(contigs(spark, ASM), Q, runs)


@pytest.fixture(scope="module")
def ops(cohort, ref):
    return edits.align(cohort, ref)


@pytest.fixture(scope="module")
def spans(spark, cohort, ops):
    from strandlake.scratch import Scratch

    return Scratch(spark).save(edits.runs(cohort, ops), "runs")


def stream(a, case=True):
    s = list("".join(ASM[a].values()))
    for at, n in LOWER if case else []:
        s[at : at + n] = [c.lower() for c in s[at : at + n]]
    return "".join(s)


def test_colocated_requests_leave_blocks_in_place(spark, cohort):
    """The same windows, in any order of the requests, and a plan whose one exchange is that of the requests."""
    near = cohort.colocated(4)
    asked = cohort.sample_coordinates(200, 700, seed=5, rc_percent=50).select("id", "asm_id", "start", "length", "rc")
    asked = asked.unionByName(asked.withColumn("id", F.col("id") + 1000).withColumn("length", F.lit(0).cast("long")))
    want = sorted(cohort.windows(asked).collect())
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for order in ("id", "start"):
            assert sorted(near.windows(asked.orderBy(order)).collect()) == want
        rows = spark.createDataFrame([(k, k % 4, 100 * k) for k in range(8)], "id long, asm_id int, start long")
        rows = rows.withColumn("block_ix", F.floor(F.col("start") / Q))
        joined = rows.join(near.blocks, ["asm_id", "block_ix"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert near.windows(asked)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(asm_id") < cohort.windows(asked)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(asm_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_windows_cross_blocks_and_contigs(spark, cohort):
    r = random.Random(1)
    rows = []
    for i, w in enumerate([0, 1, 13, 1023, 1024, 1025, 4097, 9000] * 8):
        k = r.randrange(4)
        rows.append((i, k, r.randrange(len(stream(list(ASM)[k])) - w), w, bool(i % 2)))
    asked = spark.createDataFrame(rows, "id long, asm_id int, start long, length long, rc boolean")
    for got in cohort.windows(asked).collect():
        s = stream(list(ASM)[got.asm_id])[got.start : got.start + got.length]
        assert got.seq == (rc(s) if got.rc else s)
    for got in cohort.windows(asked, tokens=True).collect():
        s = stream(list(ASM)[got.asm_id], False)[got.start : got.start + got.length]
        assert got.seq == re.sub("[^ACGT]", "4", rc(s) if got.rc else s).translate(str.maketrans("ACGT", "0123"))


def test_fetch_and_its_errors(spark, cohort):
    schema = "id string, assembly string, contig string, start0 long, length long, rc boolean"
    rows = [(f"{a}{n}{k}", a, n, k % (len(s) + 1), (len(s) - k % (len(s) + 1)) // (1 + k % 3), k % 2 == 1) for a, c in ASM.items() for n, s in c.items() for k in (0, 7, 500)]
    cased = {a: dict(zip(c, re.findall("(?s)" + "".join(f"(.{{{len(s)}}})" for s in c.values()), stream(a))[0], strict=True)) for a, c in ASM.items()}
    got = cohort.fetch(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    for r in got:
        s = cased[r.assembly][r.contig][r.start0 : r.start0 + r.length]
        assert r.seq == (rc(s) if r.rc else s)
    for bad in (("x", "y1_P1.1", "ctg3", 2990, 11, False), ("x", "y1_P1.1", "ctg3", -1, 5, False), ("x", "y1_P1.1", "nope", 0, 1, False), ("x", "nope", "ctg3", 0, 1, False)):
        with pytest.raises(PySparkException):
            cohort.fetch(spark.createDataFrame([bad], schema)).collect()
    with pytest.raises(FileNotFoundError):
        cohort.subset(["y1_P1.1", "nope"])
    assert cohort.subset(["y1_P2.1"]).names().count() == 1
    with pytest.raises(PySparkException):
        Cohort.build(contigs(spark, {"a": {"x": "A"}}).union(contigs(spark, {"a": {"x": "C"}}).withColumn("order", F.lit(5).cast("long"))), Q)
    with pytest.raises(ValueError):
        Cohort.build(contigs(spark, {"a": {"x": "A"}}), 1000)


def test_regions_are_one_based(spark, cohort):
    rows = [("a", "y1_P1.1", "ctg3:2-70"), ("b", "y1_P1.1", "short5"), ("c", "y1_P1.1", "ctg3:2995")]
    got = {r.id: r.fasta for r in cohort.regions(spark.createDataFrame(rows, "id string, assembly string, region string")).collect()}
    s = stream("y1_P1.1")
    at = sum(len(ASM["y1_P1.1"][n]) for n in ("ctg1", "ctg2"))
    c = s[at : at + 3000]
    assert got["a"] == f">ctg3:2-70\n{c[1:61]}\n{c[61:70]}\n" and got["c"] == f">ctg3:2995\n{c[2994:]}\n" and got["b"].count("\n") == 2


def test_samples_are_spread_over_all_starts(cohort):
    w = 1000
    got = cohort.sample(3000, w, seed=3, rc_percent=50).collect()
    assert len(got) == 3000 and all(len(r.seq) == w for r in got)
    c = {(r.asm_id, r.contig_ix): r for r in cohort.contigs.collect()}
    assert all(r.start0 + w <= c[r.asm_id, r.contig_ix].len for r in got)
    total = sum(max(0, x.len - w + 1) for x in c.values())
    big = max(c.values(), key=lambda x: x.len)
    share = sum((r.asm_id, r.contig_ix) == (big.asm_id, big.contig_ix) for r in got) / 3000
    assert abs(share - (big.len - w + 1) / total) < 0.03 and 0.4 < sum(r.rc for r in got) / 3000 < 0.6
    assert got[0].seq in (stream(list(ASM)[got[0].asm_id])[got[0].start : got[0].start + w], rc(stream(list(ASM)[got[0].asm_id])[got[0].start : got[0].start + w]))
    with pytest.raises(ValueError):
        cohort.sample_coordinates(1, 10**6)


def test_lines_of_a_whole_contig_take_one_pass(spark):
    s = dna(1000, 5) * 20_000
    cases = [("", 60), ("A", 60), (s[:60], 60), (s[:61], 60), (s[:120], 60), (s[:10], 10**6), (s, 61), (s, len(s))]
    rows = spark.createDataFrame([(i, x, w) for i, (x, w) in enumerate(cases)], "i int, x string, w int")
    got = {r.i: r.h for r in rows.select("i", F.sha2(B.wrapped(F.col("x"), F.col("w")), 256).alias("h")).collect()}
    for i, (x, w) in enumerate(cases):
        want = "".join(x[k : k + w] + "\n" for k in range(0, len(x), w))
        assert got[i] == hashlib.sha256(want.encode()).hexdigest()


def test_draws_are_not_on_a_lattice(spark):
    n, most = 200_000, 10**12
    got = spark.range(n).select((B.drawn(F.col("id"), 3) % most).alias("x")).agg(F.countDistinct("x"), F.countDistinct(F.floor(F.col("x") / (most // 1000)))).first()
    assert got[0] == n and got[1] == 1000


def test_fasta_round_trip_through_files(spark, cohort, tmp_path):
    for a, c in ASM.items():
        s, at, records = stream(a), 0, []
        for n, x in c.items():
            records.append(fasta.Record(f"{n} of {a}", s[at : at + len(x)].encode(), 60 if x else 0))
            at += len(x)
        (tmp_path / f"{a}.fa").write_bytes(fasta.render(records))
    rows, runs = fasta.read_fasta(spark, str(tmp_path))
    again = Cohort.build(rows, Q, runs)
    a, b = (sorted(map(str, c.decode().collect())) for c in (cohort, again))
    assert a == b
    made = {(r.asm_id, r.contig_ix): r.record for r in again.fasta_records().collect()}
    want = (tmp_path / "y1_P2.1.fa").read_text()
    assert "".join(made[k] for k in sorted(made) if k[0] == 2) == want
    assert {r.complete for r in cohort.check_full().collect()} == {True}
    cohort.write_fasta(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where(F.col("value").startswith(">")).count() == sum(map(len, ASM.values()))


PATTERNS = [(1, REF["chrA"][100:123]), (2, rc(REF["chrA"][2500:2523])), (3, REF["chrB"][40:63]), (4, "ACGTTGCAACACGTTGCAACACG"), (5, dna(23, 999)), (6, REF["chrA"][1990:2013]), (7, ASM["y1_P1.1"]["short23"])]


def brute_hits():
    out = set()
    for k, (a, c) in enumerate(ASM.items()):
        for j, s in enumerate(c.values()):
            for pid, p in PATTERNS:
                for strand, x in ((0, p), (1, rc(p))):
                    out |= {(k, j, m.start(), pid, strand) for m in re.finditer(f"(?={x})", s)}
    return out


def test_exact_search_and_transfer(spark, cohort, ref, ops, spans):
    patterns = spark.createDataFrame(PATTERNS, "pid long, seq string")
    found = kmers.search(cohort, patterns)
    assert {tuple(r) for r in found.collect()} == brute_hits() and found.count() == len(brute_hits())
    carried = edits.search_by_transfer(cohort, ref, spans, patterns)
    assert kmers.same_hits(carried.drop("origin"), found).isEmpty()
    origin = {r.origin for r in carried.collect()}
    assert origin == {"transfer", "residual"}
    # negative controls: what must be caught is
    once = kmers.search(ref, patterns)
    gone = edits.residual_chunks(cohort, edits.residual(cohort, spans, 23))
    rest = kmers.search(cohort, patterns, gone)
    for broken in ({"flip": False}, {"reverse": False}):
        assert not kmers.same_hits(edits.transfer(once, spans, ref, 23, **broken).unionByName(rest), found).isEmpty()
    assert kmers.same_hits(edits.transfer(once, spans, ref, 23).unionByName(rest), found).isEmpty()
    a, b = (kmers.digest(h, ["asm_id"]) for h in (found, carried.drop("origin")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_search_by_join_beyond_the_limit(spark, cohort, monkeypatch):
    patterns = spark.createDataFrame(PATTERNS, "pid long, seq string")
    monkeypatch.setattr(kmers, "PATTERNS", 3)
    assert {tuple(r) for r in kmers.search(cohort, patterns).collect()} == brute_hits()


def test_guides_every_way(spark, cohort, ref, spans):
    guides = [(k, REF["chrA"][p : p + 20]) for k, p in enumerate(range(50, 8000, 400))]
    table = spark.createDataFrame(guides, "gid long, spacer string")
    want = set()
    for k, c in enumerate(ASM.values()):
        for j, s in enumerate(c.values()):
            for at in range(len(s) - 22):
                w = s[at : at + 23]
                if set(w) <= set("ACGT"):
                    for strand, x in ((0, w), (1, rc(w))):
                        if x.endswith("GG"):
                            for gid, g in guides:
                                mm = sum(a != b for a, b in zip(x[:20], g))
                                if mm <= 6:
                                    want.add((k, j, at, gid, strand, mm))
    found = kmers.guide_sites(cohort, table, 6)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert kmers.same_hits(kmers.seeded_sites(cohort, table, 6), found).isEmpty()
    assert kmers.same_hits(edits.sites_by_transfer(cohort, ref, spans, table, 6).drop("origin"), found).isEmpty()


def test_edits_give_the_blocks_back(spark, cohort, ref, ops):
    a = edits.execute(ops, ref)
    b = cohort.blocks.select("asm_id", "block_ix", F.col("seq").cast("string").alias("seq"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    kinds = {r.kind: r.bases for r in edits.copy_statistics(ops).collect()}
    assert set(kinds) == {0, 1, 3} and kinds[1] + kinds[3] > 0.7 * sum(kinds.values())


def test_both_ways_to_align_agree(cohort, ref, ops, monkeypatch):
    monkeypatch.setattr(edits, "LOCAL", 0)
    joined = edits.align(cohort, ref)
    assert joined.exceptAll(ops).isEmpty() and ops.exceptAll(joined).isEmpty()


def test_no_diagonal_is_lost_behind_many_others(spark, monkeypatch):
    often, once = dna(924, 900), dna(100, 901)
    own = {f"copy{k}": dna(k % 8, 910 + k) + often for k in range(45)} | {"one": dna(500, 902) + once + dna(500, 903)}
    reference = Cohort.build(contigs(spark, {"ref": own}), Q)
    read = Cohort.build(contigs(spark, {"a": {"x": often + once}, "b": {"x": rc(often + once)}}), Q)
    ops = edits.align(read, reference)
    assert ops.where("kind = 0").isEmpty()
    assert ops.where("kind = 1").count() == ops.where("kind = 3").count() == 2
    monkeypatch.setattr(edits, "LOCAL", 0)
    joined = edits.align(read, reference)
    assert joined.exceptAll(ops).isEmpty() and ops.exceptAll(joined).isEmpty()


def test_located_bases_are_the_references(spark, cohort, ref, ops):
    points = spark.createDataFrame([(k, p) for k, a in enumerate(ASM) for p in range(0, len(stream(a)), 37)], "asm_id int, pos long")
    whole = "".join(REF.values())
    for r in edits.locate(cohort, ops, points).collect():
        base = stream(list(ASM)[r.asm_id], False)[r.pos]
        if r.ref_pos is None:
            assert r.cls == 0
        else:
            assert base == (whole[r.ref_pos] if r.ref_strand == "+" else rc(whole[r.ref_pos]))


def test_runs_are_maximal_spans(cohort, ref, spans):
    whole, names = "".join(REF.values()), list(ASM)
    for r in spans.collect():
        s = list(ASM[names[r.asm_id]].values())[r.contig_ix][r.a : r.a + r.len]
        t = whole[r.ref_lo : r.ref_lo + r.len]
        assert s == (rc(t) if r.dir else t)


def test_generated_patterns_are_found_where_they_were_cut(spark, cohort, ref, ops, spans):
    places = edits.pattern_candidates(cohort, ops, spans)
    assert {r["class"] for r in places.select("class").distinct().collect()} >= {"ref", "lit", "contig_end", "block_edge"}
    made = edits.generate_patterns(cohort, places, {"ref": 30, "lit": 30, "boundary": 20, "short_ins": 20, "contig_end": 20, "block_edge": 20})
    hit = {r.pid for r in kmers.search(cohort, made).select("pid").distinct().collect()}
    assert hit == {r.pid for r in made.collect()} and hit
    assert edits.jump_histogram(ops).count() > 0


def test_contig_of_and_variable_samples(spark, cohort):
    points = spark.createDataFrame([(k, p) for k, a in enumerate(ASM) for p in range(0, len(stream(a)), 501)], "asm_id int, pos long")
    for r in cohort.contig_of(points).collect():
        sizes = [len(s) for s in list(ASM.values())[r.asm_id].values()]
        assert sum(sizes[: r.contig_ix]) + r.start0 == r.pos and r.start0 < sizes[r.contig_ix]
    asked = cohort.sample_variable(300, seed=2)
    assert cohort.fetch(asked).where(F.length("seq") == F.col("length")).count() == 300


def test_leak(spark, cohort, ops):
    w = 256
    tiles = edits.tilemap(cohort, ops, w).collect()
    assert len(tiles) == sum(len(s) // w for c in ASM.values() for s in c.values())
    good = [t for t in tiles if t.ref_lo is not None and abs(t.ref_hi - t.ref_lo - w) <= w // 10]
    train = {k for k, a in enumerate(ASM) if a[3:5] in ("P1", "P3")}
    covered = {p for t in good if t.asm_id in train for p in range(t.ref_lo, t.ref_hi)}
    shares = sorted(sum(p in covered for p in range(t.ref_lo, t.ref_hi)) / (t.ref_hi - t.ref_lo) for t in good if t.asm_id not in train)
    got = edits.leak(None, w, edits.by_people(edits.tilemap(cohort, ops, w), cohort.names())).first()
    assert (got.test_windows, got.half, got.ninety, got.zero) == (len(shares), sum(s >= 0.5 for s in shares), sum(s >= 0.9 for s in shares), shares.count(0))
    assert abs(got.mean_share - sum(shares) / len(shares)) < 1e-8
    locus = edits.leak(None, w, edits.by_locus(edits.tilemap(cohort, ops, w), 2048)).first()
    assert locus.test_windows and locus.mean_share < got.mean_share


def test_merge_and_overlap(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), s := r.randrange(0, 5_000_000, 7), s + r.choice([0, 1, 7, 50, 3_000_000])) for _ in range(300)] + [(0, 10, 20), (0, 20, 30), (0, 31, 31)]
    got = sorted(tuple(x) for x in joins.merged(spark.createDataFrame(rows, "k int, lo long, hi long"), ["k"]).collect())
    want = []
    for k, lo, hi in sorted(x for x in rows if x[2] > x[1]):
        if want and want[-1][0] == k and lo <= want[-1][2]:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([k, lo, hi])
    assert got == sorted(map(tuple, want))
    a = spark.createDataFrame([(i, r.randrange(900), 0) for i in range(80)], "i int, lo long, hi long").withColumn("hi", F.col("lo") + F.col("i") % 60)
    b = spark.createDataFrame([(j, r.randrange(900), 0) for j in range(80)], "j int, rlo long, rhi long").withColumn("rhi", F.col("rlo") + F.col("j") * 7 % 90)
    pairs = sorted((x.i, x.j) for x in joins.overlap_join(a, b, [], 16).collect())
    assert pairs == sorted((x.i, y.j) for x in a.collect() for y in b.collect() if max(x.lo, y.rlo) < min(x.hi, y.rhi))


def test_training_rows(cohort):
    size = 500
    table = {"A": 8, "C": 5, "G": 6, "T": 7}
    whole = []
    for a in ASM:
        for s in ASM[a].values():
            whole += [table.get(c, 9) for c in s] + [12]
    got = sorted(training.batches(cohort, size).collect(), key=lambda r: r.row)
    assert len(got) == (len(whole) - 1) // size
    for r in got:
        x = whole[r.row * size : r.row * size + size + 1]
        assert r.tokens == x[:-1] and r.labels == x[1:] and r.loss_mask == [float(t != 12) for t in x[:-1]]
        place, want = 0, []
        for t in x[:-1]:
            want.append(place)
            place = 0 if t == 12 else place + 1
        assert r.position_ids == want


def test_base_functions(spark):
    rows = spark.createDataFrame([("ACGTNRYacgtn",), ("A",), ("",)], "s string")
    got = rows.select(B.reverse_complement(F.col("s")).alias("r"), B.tokens(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("nacgtYRNACGT", "012344401234"), ("T", "0"), ("", "")]
    k = spark.createDataFrame([(dna(23, i), dna(23, i + 90)) for i in range(50)], "a string, b string")
    for r in k.select("a", "b", B.mismatches(B.code(F.col("a")), B.code(F.col("b"))).alias("m"), B.from_code(B.code(F.col("a")), 23).alias("x"), B.canonical(F.col("a")).alias("c")).collect():
        assert r.m == sum(x != y for x, y in zip(r.a, r.b)) and r.x == r.a and r.c == min(r.a, rc(r.a))
    simple = spark.createDataFrame([("ACACACACACACACACACACACA",), (dna(23, 5),), ("A" * 23,), ("ACGACGACGACGACGACGACGTC",)], "s string")
    assert [r[0] for r in simple.select(B.is_simple_repeat(F.col("s"), 23)).collect()] == [True, False, True, True]


def test_archives_in_a_folder(spark, cohort, ref, ops, tmp_path):
    data = fasta.render([fasta.Record(n, s.encode(), 60 if s else 0) for n, s in ASM["y1_P1.1"].items()])
    own = [[] for _ in range(200)]
    for r in ops.where("asm_id = 0 and kind > 0").orderBy("block_ix", "op_ix").collect():
        own[r.block_ix].append((r.kind, r.dst, r.len, r.src))
    whole = "".join(REF.values()).encode()
    made = codec.encode(data, whole, "ref", Q, own)
    files = spark.createDataFrame([("one", bytearray(made)), ("two", bytearray(made))], "assembly string, content binary")
    assert archive.export(files, str(tmp_path), "q1k") == 2
    back = archive.read_files(spark, str(tmp_path), "q1k")
    assert [bytes(r.fasta) for r in archive.decode_fasta(back, whole).collect()] == [data] * 2
    got = archive.decode_blocks(archive.read_files(spark, str(tmp_path), "q1k", ["two"]), whole)
    assert "".join(bytes(r.seq).decode() for r in got.orderBy("block_ix").collect()) == "".join(ASM["y1_P1.1"].values())
    assert archive.headers(back).first().nbases == len("".join(ASM["y1_P1.1"].values()))
    assert archive.block_size(back) == Q
    other = spark.createDataFrame([("four", bytearray(codec.encode(data, whole, "ref", 2048, [])))], "assembly string, content binary")
    with pytest.raises(fasta.FormatError, match="mixed"):
        archive.block_size(back.union(other))
    with pytest.raises(FileNotFoundError):
        archive.read_files(spark, str(tmp_path), "q1k", ["three"])
    with pytest.raises(ValueError):
        archive.dataset_glob("4k")
    with pytest.raises(PySparkException):
        archive.decode_fasta(back, whole[:-1]).collect()
    assert {r.outcome for r in archive.corruption(back.limit(1), whole, 5).collect()} <= {"refused", "caught", "harmless"}


def test_recoded_archives_hold_copies_at_every_block_size(spark):
    from strandlake.plans import catalogue
    from strandlake.plans import datasets as D

    sf_dir = "/root/testdata/sf0.001"
    rows = catalogue.archive_recode(spark, sf_dir).collect()
    assert len(rows) == 2 * D.HAPLOTYPES and {r.q for r in rows} == {4096, 16384} and {r.status for r in rows} == {"ok"}
    assert all(r.bytes < r.fasta_bytes / 8 for r in rows)  # two bits a base, without one copy, is more


def test_every_archive_is_damaged(spark):
    from strandlake.plans import catalogue
    from strandlake.plans import datasets as D

    rows = catalogue.corruption_matrix(spark, "/root/testdata/sf0.001").collect()
    assert {r.kind for r in rows} == set(archive.KINDS) and sum(r.n for r in rows) == D.HAPLOTYPES * len(archive.KINDS) * 10
    assert {r.outcome for r in rows} <= {"refused", "caught", "harmless"}


def test_tables(spark, tmp_path):
    (tmp_path / "requests.tsv").write_text('r1\ty1_P1.1\tctg#1\t5\t10\nr2\t"q\tc\t0\t1\n')
    rows = tables.read_tsv(spark, str(tmp_path / "requests.tsv"), "requests").collect()
    assert [r.contig for r in rows] == ["ctg#1", "c"] and rows[1].assembly == '"q'
    tables.write_tsv(spark.createDataFrame([("a", 1)], "x string, y int").coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x\ty", "a\t1"]
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, v string")
    known = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "name string, v string")
    assert dict(map(tuple, tables.against_manifest(found, known, "name", "v").collect())) == {"a": "ok", "b": "differs", "c": "unknown", "d": "missing"}


def test_requests_from_a_stream(spark, cohort, tmp_path):
    rows = [("a", "y1_P1.1", "ctg3", 5, 100, False), ("b", "y1_P2.1", "short5", 0, 5, True)]
    schema = "id string, assembly string, contig string, start0 long, length long, rc boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = serve(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cohort, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.id: len(r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 100, "b": 5}


def _write_files(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def _rows(df, *columns):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect())


def test_scan_of_splits_equals_the_reader(spark, tmp_path):
    """Files cut every 700 bytes: records across many splits, headers at their ends, empty records, case, gzip."""
    import gzip

    files = {}
    for a, c in ASM.items():
        lower = lambda s: "".join(x.lower() if i % 97 < 30 else x for i, x in enumerate(s))
        records = [fasta.Record(f"{n} of {a}", lower(s).encode(), 61 if s else 0) for n, s in c.items()]
        files[f"{a}.fa"] = fasta.render(records)
    files["z.fa.gz"] = gzip.compress(files["y1_P1.1.fa"])
    files["empty.fa"] = b""
    path = _write_files(tmp_path, files)
    want, want_runs = fasta.read_fasta(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scan = fasta_scan.scan_fasta(spark, path)
        assert scan.pieces.count() > 300
        together = scan.pieces.groupBy("assembly", "order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.col("seq").cast("string").alias("s")))), lambda x: x["s"]), "").alias("seq"))
        got = scan.records.join(together, ["assembly", "order"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))
        assert _rows(got, "assembly", "order", "header", "line_width", "seq") == _rows(want.withColumn("seq", F.col("seq").cast("string")), "assembly", "order", "header", "line_width", "seq")
        assert _rows(scan.case_runs, "assembly", "start", "len") == _rows(want_runs, "assembly", "start", "len")
        a, b = Cohort.build(want, Q, want_runs), Cohort.from_pieces(scan.records, scan.pieces, Q, scan.case_runs)
        for t in ("contigs", "blocks", "chunks", "case_runs"):
            columns = getattr(a, t).columns
            assert _rows(getattr(b, t), *columns) == _rows(getattr(a, t), *columns), t
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    b.write_fasta(str(tmp_path / "out"))
    again = fasta_scan.scan_fasta(spark, str(tmp_path / "out"), "*", folders=True)
    assert _rows(again.records, "assembly", "order", "header", "len") == _rows(scan.records, "assembly", "order", "header", "len")
    assert _rows(again.case_runs, "assembly", "start", "len") == _rows(want_runs, "assembly", "start", "len")


def test_scan_refuses_what_the_reader_refuses(spark, tmp_path):
    for i, (bad, what) in enumerate([(b"ACGT\n", "no header"), (b">a\nACG\nAC\nACG\n", "irregular"), (b">a\nAC\nACG\n", "irregular"), (b">a\nACG\n\n", "irregular"), (b">a\nACG", "no final line end"), (b">a\n\nAC\n", "irregular")]):
        folder = tmp_path / str(i)
        folder.mkdir()
        with pytest.raises(Exception, match=what):
            fasta_scan.scan_fasta(spark, _write_files(folder, {"x.fa": bad})).records.collect()


def test_data_source_reads_by_index(spark, tmp_path):
    records = {a: [fasta.Record(f"{n} of {a}", s.encode(), 50 if s else 0) for n, s in c.items()] for a, c in ASM.items()}
    path = _write_files(tmp_path, {f"{a}.fa": fasta.render(r) for a, r in records.items()})
    fasta_scan.write_index(fasta_scan.scan_fasta(spark, path), str(tmp_path / "index"))
    fasta_scan.register(spark)
    all_ = spark.read.format("strandlake_fasta").option("path", str(tmp_path / "index")).option("piece", 500).option("split", 1500).load()
    want = sorted((a, i, r.name, s, r.bases[s : s + 500].decode()) for a, c in records.items() for i, r in enumerate(c) for s in range(0, len(r.bases), 500))
    assert _rows(all_, *all_.columns) == want and all_.rdd.getNumPartitions() > 20
    again = spark.read.format("strandlake_fasta").option("path", str(tmp_path / "index")).option("piece", 500).option("split", 1500).load()
    some = again.where("assembly = 'y1_P2.1' and name in ('ctg2', 'ctg3') and start >= 700 and start < 2100")
    assert _rows(some, *some.columns) == [w for w in want if w[0] == "y1_P2.1" and w[2] in ("ctg2", "ctg3") and 700 <= w[3] < 2100]
    assert some.rdd.getNumPartitions() <= 4


def test_hashes_of_parts_that_stream_by(spark, cohort):
    assert {(r.asm_id, r.contig_ix): (r.sha256, r.complete) for r in cohort.check_full().collect()} == {(r.asm_id, r.contig_ix): (hashlib.sha256(r.seq.encode()).hexdigest(), True) for r in cohort.contig_sequences().collect()}
    want = {(r.asm_id, r.contig_ix): hashlib.sha256(r.record.encode()).hexdigest() for r in cohort.fasta_records().collect()}
    assert {(r.asm_id, r.contig_ix): r.sha256 for r in cohort.fasta_digests().collect()} == want
    # lines far longer than a block, and shorter than one
    for width in (1, 7, 1024, 2500, 100_000):
        other = Cohort(cohort.spark, cohort.q, cohort.contigs.withColumn("line_width", F.lit(width)), cohort.blocks, cohort.chunks, cohort.case_runs)
        want = {(r.asm_id, r.contig_ix): r.record for r in other.fasta_records().collect()}
        assert {(r.asm_id, r.contig_ix): r.sha256 for r in other.fasta_digests().collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
        lines = {}
        for r in sorted(other.fasta_lines().collect(), key=lambda r: (r.asm_id, r.contig_ix, r.at)):
            lines[r.asm_id, r.contig_ix] = lines.get((r.asm_id, r.contig_ix), "") + r.text + "\n"
        assert lines == want


def test_token_access(spark, cohort):
    docs = {r.doc_ix: r for r in training.documents(cohort).collect()}
    whole = {(r.asm_id, r.contig_ix): r.tokens for r in training.document_tokens(cohort).collect()}
    tokens = {d: whole[r.asm_id, r.contig_ix] for d, r in docs.items()}
    r = random.Random(3)
    asked = []
    for d, t in tokens.items():
        for lo in (0, len(t) - 1, r.randrange(len(t))):
            for n in (0, 1, len(t) - lo):
                asked.append((len(asked), d, lo, n))
    schema = "id int, doc_ix long, offset long, length long"
    got = {x.id: (x.tokens, x.ends) for x in training.get(cohort, spark.createDataFrame(asked, schema)).collect()}
    assert got == {i: (tokens[d][lo : lo + n], n > 0 and lo + n == len(tokens[d])) for i, d, lo, n in asked}
    some = sorted(tokens)[1::3]
    sub = spark.createDataFrame([(d,) for d in some], "doc_ix long")
    got = training.get(cohort, spark.createDataFrame([(i, i, 0, len(tokens[d])) for i, d in enumerate(some)], schema), sub).collect()
    assert {x.id: x.tokens for x in got} == {i: tokens[d] for i, d in enumerate(some)}
    for bad in ((0, 10**9, 0, 1), (0, 0, -1, 1), (0, 0, 0, len(tokens[0]) + 1), (0, len(some), 0, 1)):
        with pytest.raises(PySparkException, match="no such tokens"):
            training.get(cohort, spark.createDataFrame([bad], schema), sub if bad[1] == len(some) else None).collect()
    pieces = {}
    for p in sorted(training.token_pieces(cohort).collect(), key=lambda p: (p.asm_id, p.contig_ix, p.at)):
        pieces.setdefault((p.asm_id, p.contig_ix), []).extend(p.tokens)
    assert pieces == whole


def _union(rows):
    out = []
    for k, lo, hi in sorted((x for x in rows if x[2] > x[1]), key=lambda x: (str(x[0]), *x[1:])):
        if out and out[-1][0] == k and lo <= out[-1][2]:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([k, lo, hi])
    return sorted(map(tuple, out), key=str)


def test_a_key_is_merged_in_ranges(spark):
    """Spans over many ranges, ranges without a new run, a null key, one place with most rows: as in one go."""
    r = random.Random(8)
    rows = [(r.choice([0, 0, 0, 0, 1, None]), s := r.randrange(0, 20_000, 3), s + r.choice([0, 1, 3, 5, 40])) for _ in range(2500)]
    rows += [(0, 900, 4200), (0, 4200, 4201), (0, 15_000, 15_000), (None, 5, 9000), (0, 19_000, 30_000)] + [(0, 77, 78 + i % 3) for i in range(1000)]
    table = spark.createDataFrame(rows, "k int, lo long, hi long")
    for most in (40, 300, 10**6):
        assert sorted(map(tuple, joins.merged(table, ["k"], most).collect()), key=str) == _union(rows), most
    plain = table.select("lo", "hi")
    assert sorted(map(tuple, joins.merged(plain, [], 50).collect())) == [x[1:] for x in sorted(_union([(0, *x[1:]) for x in rows]))]
    lengths = spark.createDataFrame([(0, 40_000), (1, 40_000), (9, 10)], "k int, length long")
    got = {x.k: (x.covered, x.uncovered_share) for x in joins.covered(table, ["k"], lengths).collect()}
    size = {k: sum(hi - lo for j, lo, hi in _union(rows) if j == k) for k in (0, 1)}
    assert got == {0: (size[0], 1 - size[0] / 40_000), 1: (size[1], 1 - size[1] / 40_000), 9: (0, 1.0)}


def test_seeded_splits_are_exact(spark, cohort, ops):
    names = spark.createDataFrame([(i, f"y1_P{i // 2}.{i % 2 + 1}") for i in range(26)], "asm_id int, assembly string")
    tiles = spark.createDataFrame([(i, 0, k, 100 * k, 100 * k + 50) for i in range(26) for k in range(40)], "asm_id int, contig_ix int, start0 long, ref_lo long, ref_hi long")
    seen = set()
    for seed in range(6):
        side = {}
        for r in edits.by_people(tiles, names, seed).collect():
            side.setdefault(r.asm_id // 2, set()).add(r.train)
        assert all(len(x) == 1 for x in side.values()) and sum(x == {True} for x in side.values()) == 6
        seen.add(frozenset(k for k, x in side.items() if x == {True}))
        coins = {}
        for r in edits.by_locus(tiles, 200, seed).collect():
            coins.setdefault(r.ref_lo // 200, set()).add(r.train)
        assert all(len(x) == 1 for x in coins.values()) and 2 <= sum(x == {True} for x in coins.values()) <= 18
    assert len(seen) > 3


def test_summaries_of_tiles_and_copies(spark, cohort, ops, spans):
    w = 256
    tiles = edits.tilemap(cohort, ops, w)
    rows = tiles.collect()
    got = edits.tile_summary(tiles, w).first()
    both = [t for t in rows if t.ref_lo is not None]
    assert got.windows == len(rows) and got.both_ends == len(both) and got.literal_end == sum(0 in (t.cls_start, t.cls_end) for t in rows)
    assert got.span_off == sum(abs(t.ref_hi - t.ref_lo - w) > w // 10 for t in both)
    shares, each = edits.copy_shares(ops).first(), {r.kind: r for r in edits.copy_statistics(ops).collect()}
    total = sum(r.bases for r in each.values())
    assert shares.bases == total and abs(shares.rc_percent - 100 * each[3].bases / total) < 1e-9 and shares.own_percent == 0
    assert abs(shares.ref_percent + shares.lit_percent - 100) < 1e-9 and shares.copies == each[1].ops + each[3].ops
    bits = {(r.field, r.context): r.bits for r in edits.code_lengths(ops).collect()}
    assert all(bits[f, "own kind"] <= bits[f, "none"] + 1e-6 and bits[f, "kind before"] <= bits[f, "none"] + 1e-6 for f in ("kind", "length", "jump"))
    assert bits["kind", "own kind"] == 0
    for r in edits.haplotype_coverage(cohort, spans).collect():
        mine = {(x.contig_ix, p) for x in spans.where(F.col("asm_id") == r.asm_id).collect() for p in range(x.a, x.a + x.len)}
        assert r.covered == len(mine) and abs(r.uncovered_share - (1 - len(mine) / r.length)) < 1e-12


def test_transfer_by_joins_and_by_slices_agree(spark, cohort, ref, spans, monkeypatch):
    table = spark.createDataFrame([(k, REF["chrA"][p : p + 23]) for k, p in enumerate(range(0, 8900, 90))] + [(5000, "A" * 23)], "pid long, seq string")
    hits = kmers.search(ref, table)
    full = kmers.search(cohort, table)
    stored = edits.stored_gaps(cohort, spans)
    for flip, reverse in ((True, True), (False, True), (True, False)):
        few = edits.transfer(hits, spans, ref, 23, flip, reverse)
        with monkeypatch.context() as m:
            m.setattr(edits, "PLACED", 3)
            joined = edits.transfer(hits, spans, ref, 23, flip, reverse)
        assert few.columns == joined.columns == hits.columns and few.dtypes == hits.dtypes
        assert kmers.same_hits(few, joined).isEmpty() and not few.isEmpty()
    assert kmers.same_hits(edits.search_by_transfer(cohort, ref, spans, table, stored).drop("origin"), full).isEmpty()
    nothing = spark.createDataFrame([(1, "ACGT" * 5 + "AAA")], "pid long, seq string")
    assert edits.search_by_transfer(cohort, ref, spans, nothing, stored).drop("origin").exceptAll(kmers.search(cohort, nothing)).isEmpty()
    guides = spark.createDataFrame([(k, REF["chrA"][p : p + 20]) for k, p in enumerate(range(50, 8000, 800))], "gid long, spacer string")
    assert kmers.same_hits(edits.sites_by_transfer(cohort, ref, spans, guides, 4, stored).drop("origin"), kmers.guide_sites(cohort, guides, 4)).isEmpty()


def _plain(ops):
    """What a block's ops stand for, base by base: (kind, place, hops) of each, a literal's place being its base."""
    out = []
    for o in ops:
        for j in range(o["len"]):
            if o["kind"] == 2:
                kind, place, hops = out[o["src"] + j]
                out.append((kind, place, hops + 1))
            else:
                place = o["lit"][j] if o["kind"] == 0 else o["src"] + j if o["kind"] == 1 else o["src"] + o["len"] - 1 - j
                out.append((o["kind"], place, 0))
    return out


def test_chains_of_copies_base_by_base():
    r = random.Random(6)
    for _ in range(300):
        ops, at = [], 0
        for _ in range(r.randrange(1, 12)):
            kind, n = r.choice([0, 1, 2, 2, 2, 3]) if at else r.choice([0, 1, 3]), r.randrange(1, 30)
            ops.append({"kind": kind, "dst": at, "len": n, "src": r.randrange(at) if kind == 2 else r.randrange(1000), "lit": dna(n, r.random()).encode() if kind == 0 else None})
            at += n
        got = []
        for lo, n, kind, src, hops, lit in chains.chase(ops):
            assert lo == len(got)
            got += [(kind, lit[j] if kind == 0 else src + j if kind == 1 else src + n - 1 - j, hops) for j in range(n)]
        assert got == _plain(ops)
    with pytest.raises(ValueError, match="before"):
        chains.chase([{"kind": 0, "dst": 0, "len": 2, "src": 0, "lit": b"AC"}, {"kind": 2, "dst": 2, "len": 2, "src": 2, "lit": None}])


def test_the_parse_scores_most():
    """Against all ways to write a literal run by the copies found at its places."""
    r = random.Random(7)
    for _ in range(60):
        unit = dna(r.randrange(20, 40), r.random())
        x = (dna(30, r.random()) + unit + dna(r.randrange(25), r.random()) + unit[r.randrange(5) :] + unit).encode()
        best, back = chains._earlier(x)
        assert all(x[i - back[i] :][: best[i]] == x[i : i + best[i]] for i in range(len(x)) if best[i])
        ops = chains._parsed(x, [{"kind": 0, "dst": 0, "len": len(x), "src": 0, "lit": x}])
        score = [0.0] * (len(x) + 1)
        for i in range(len(x) - 1, -1, -1):
            score[i] = max([score[i + 1]] + [chains.GAIN * k - chains.COST + score[i + k] for k in range(1, int(best[i]) + 1)])
        assert abs(sum(chains.GAIN * o["len"] - chains.COST for o in ops if o["kind"] == 2) - score[0]) < 1e-9
        assert [o["dst"] for o in ops] == [sum(o["len"] for o in ops[:i]) for i in range(len(ops))]
        assert bytes(p for _, p, _ in _plain(ops)) == x and any(o["kind"] == 2 for o in ops)


def test_copies_within_blocks(spark, cohort, ref, ops):
    own = chains.own_copies(cohort, ops)
    literal = lambda o: o.where("kind = 0").agg(F.sum("len")).first()[0]
    assert own.where("kind = 2").count() > 0 and literal(own) < literal(ops)
    a = chains.execute(own, ref)
    b = cohort.blocks.select("asm_id", "block_ix", F.col("seq").cast("string").alias("seq"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    pieces = chains.resolved(own)
    rows = {r.cls: r for r in chains.located(cohort, pieces, ref).collect()}
    assert sum(r.n for r in rows.values()) == sum(len(s) for c in ASM.values() for s in c.values())
    assert all(r.same == (r.n if c else 0) for c, r in rows.items()) and rows[1].hops == rows[3].hops == 0
    points = spark.createDataFrame([(k, p) for k, a in enumerate(ASM) for p in range(0, len(stream(a)), 11)], "asm_id int, pos long")
    whole, seen = "".join(REF.values()), 0
    for r in edits.locate(cohort, pieces, points).collect():
        seen += r.hops > 0
        if r.ref_pos is not None:
            base = stream(list(ASM)[r.asm_id], False)[r.pos]
            assert base == (whole[r.ref_pos] if r.ref_strand == "+" else rc(whole[r.ref_pos])) and r.cls == (2 if r.hops else {"+": 1, "-": 3}[r.ref_strand])
    assert seen
    assert not edits.pattern_candidates(cohort, own, edits.runs(cohort, own)).where("class = 'self_copy'").isEmpty()


def test_minimizers_of_common_stretches_meet():
    """Stretches of WINDOW + SEED - 1 bases that two sequences share, on either strand, share a minimizer at the same place; and chunks give what whole contigs do."""
    r = random.Random(9)
    for _ in range(150):
        n = edits.WINDOW + edits.SEED - 1
        common = r.choice([dna(n, r.random()), "ACGT" * (n // 4) + "ACG", dna(5, r.random()) * (n // 5) + "A", "A" * n])
        x, y = dna(r.randrange(60), r.random()) + common + dna(r.randrange(60), r.random()), dna(r.randrange(60), r.random(), "ACGTN") + common + dna(r.randrange(60), r.random())
        i, j = x.index(common), y.index(common)
        h, at, turned = edits.minimizers(x.encode())
        g, to, facing = edits.minimizers(y.encode())
        assert {(a, p - i, t) for a, p, t in zip(h.tolist(), at.tolist(), turned.tolist()) if i <= p <= i + n - 24} & {(a, p - j, t) for a, p, t in zip(g.tolist(), to.tolist(), facing.tolist())}
        g, to, facing = edits.minimizers(rc(y).encode())
        back = {(a, len(y) - 24 - p - j, t if t == 2 else 1 - t) for a, p, t in zip(g.tolist(), to.tolist(), facing.tolist())}
        assert {(a, p - i, t) for a, p, t in zip(h.tolist(), at.tolist(), turned.tolist())} & back
    assert [len(v) for v in edits.minimizers(b"ACGT")] == [0, 0, 0] and len(edits.minimizers(b"N" * 100)[0]) == 0
    long = dna(40_000, 12)
    assert len(edits.minimizers(long.encode())[0]) < len(long) * 0.26


def test_seeds_of_chunks_are_those_of_contigs(ref):
    want, at = set(), 0
    for s in REF.values():
        want |= {(int(h), at + int(p), int(t)) for h, p, t in zip(*edits.minimizers(s.encode()))}
        at += len(s)
    assert {tuple(r) for r in edits.reference_seeds(ref).collect()} == want


def test_longest_of_the_last_entries(spark):
    r = random.Random(10)
    right = [(k, r.randrange(400), i, r.choice([1, 5, 40, 200])) for k in (0, 1) for i in range(90)] + [(2, 50, 1, 10)] + [(0, 100, 900 + i, 3) for i in range(20)]
    left = [(r.randrange(4), i, r.randrange(-20, 450)) for i in range(400)]
    got = {x.id: (x["at"], x["len"], x.value) for x in joins.as_of_longest(spark.createDataFrame(left, "k int, id int, pos long"), spark.createDataFrame(right, "k int, at long, value long, len long"), ["k"]).collect()}
    for k, i, pos in left:
        own = sorted((at, v, n) for j, at, v, n in right if j == k)
        before = [e for e in own if e[0] <= pos]
        holds = [(n, j, (at, v, n)) for j, (at, v, n) in enumerate(before) if j >= len(before) - 16 and pos < at + n]
        want = max(holds)[2] if holds else before[-1] if before else own[0] if own else (None, None, None)
        assert got[i] == (want[0], want[2], want[1]), (k, pos)


def test_a_search_makes_no_blocks(spark, monkeypatch):
    from strandlake.scratch import Scratch

    made, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: made.append(name) or save(self, df, name))
    c = Cohort.build(contigs(spark, {"a": ASM["y1_P1.1"]}), Q)
    assert made == ["contigs"]
    got = {(r.code, r.n) for r in kmers.counted(c, 4).collect()}
    assert made == ["contigs"]
    assert got == {(r.code, r.n) for r in kmers.counted(c.with_chunks(c.chunks), 4).collect()} and made == ["contigs", "chunks"]
    windows = [s[i : i + 4] for s in ASM["y1_P1.1"].values() for i in range(len(s) - 3)]
    assert got == {(kmers.text_code(w), n) for w, n in Counter(w for w in windows if set(w) <= set("ACGT")).items()}
    assert c.blocks.count() == -(-sum(map(len, ASM["y1_P1.1"].values())) // Q) and made == ["contigs", "chunks", "blocks"]


def test_bases_of_texts():
    from strandlake.plans import datasets as D

    for text in ("", "abc xyz.,", "Ünïcödé 漢字 \U0001f600 A-Z\n\t0"):
        want = "".join(("ACGT" * 8)[D.LETTERS.index(c)] if c in D.LETTERS else "N" for c in text.lower())
        assert D.bases(text.lower().encode()).decode() == want
        assert D.bases(text.lower().encode(), True).decode() == rc(want)
    s = dna(2000, 5)
    for i in (0, 1, 7, 63):
        want = "".join(x.translate(str.maketrans("ACGT", "TGCA")) if (p * 7919 + i * 104729) % 300 == 0 else x for p, x in enumerate(s))
        assert D.mutated(s.encode(), i).decode() == want


def test_windows_for_seeds_are_found_before_rows_are_made(spark, cohort):
    """Rows are windows with a PAM, not bases."""
    plan = kmers.seeded_sites(cohort, spark.createDataFrame([(1, "ACGT" * 5)], "gid long, spacer string"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "MapInArrow" in plan


def test_no_frame_runs_from_each_row_to_its_keys_end(spark):
    """Such a frame is read anew for each row, so a key's time grows with the square of its rows."""
    left, right = spark.createDataFrame([(1, 2)], "k int, pos long"), spark.createDataFrame([(1, 1, 5, 3)], "k int, at long, value long, len long")
    for df in (joins.as_of(left, right, ["k"], "value"), joins.as_of_longest(left, right, ["k"])):
        assert not re.search(r"(?i)currentrow\$?\(?\)?, unboundedfollowing", df._jdf.queryExecution().optimizedPlan().toString())


def test_short_records_share_a_task(spark, tmp_path):
    many = {f"c{i}": dna(30 + i, i) for i in range(300)}
    path = _write_files(tmp_path, {"a.fa": fasta.render([fasta.Record(n, s.encode(), 20) for n, s in many.items()])})
    fasta_scan.write_index(fasta_scan.scan_fasta(spark, path), str(tmp_path / "index"))
    fasta_scan.register(spark)
    rows = spark.read.format("strandlake_fasta").option("path", str(tmp_path / "index")).load()
    assert {r.name: r.seq for r in rows.collect()} == many and rows.rdd.getNumPartitions() <= 8


def test_texts_of_sites(spark, cohort, spans):
    gaps = edits.residual_chunks(cohort, edits.residual(cohort, spans, kmers.K))
    every = {(r.asm_id, r.contig_ix, r.pos): r.kmer for r in kmers.extract(cohort, kmers.K).collect()}
    inside = [(r.asm_id, r.contig_ix, p) for r in edits.residual(cohort, spans, kmers.K).collect() for p in range(r.lo, r.hi, 7)]
    sites = spark.createDataFrame(inside + inside[:5], "asm_id int, contig_ix int, pos long")
    got = [((r.asm_id, r.contig_ix, r.pos), r.kmer) for r in kmers.texts_of(cohort, sites, gaps).collect()]
    assert inside and sorted(got) == sorted((at, every[at]) for at in inside)
    some = spark.createDataFrame(list(every)[::50], "asm_id int, contig_ix int, pos long")
    assert all(every[r.asm_id, r.contig_ix, r.pos] == r.kmer for r in kmers.texts_of(cohort, some, cohort.chunks).collect())


def test_minimizers_of_many_are_those_of_each():
    seqs = [dna(n, n).encode() for n in (0, 5, 23, 24, 27, 31, 32, 1024, 900)] + [(dna(100, 2) + "N" * 30 + dna(90, 3)).encode()]
    got = {i: [] for i in range(len(seqs))}
    for lo, (h, at, turned, of) in edits._minimizers_of(seqs):
        for row in zip(of.tolist(), h.tolist(), at.tolist(), turned.tolist()):
            got[lo + row[0]].append(row[1:])
    assert got == {i: list(zip(*(x.tolist() for x in edits.minimizers(s)))) for i, s in enumerate(seqs)}
    r = random.Random(1)
    assert all(int(kmers.rc_codes(kmers.codes(s.encode(), k)[0], k)[0]) == kmers.text_code(rc(s)) for k in (1, 4, 23, 31) for s in ["".join(r.choice("ACGT") for _ in range(k))])


def test_a_union_in_ranges_asks_for_no_more_quantiles_than_ranges(spark, monkeypatch):
    from strandlake.scratch import Scratch

    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and save(self, df, name))
    rows = [(k, p * 9 % 4001, p * 9 % 4001 + p % 11) for k, n in (("a", 700), ("b", 250), ("c", 20)) for p in range(n)]
    got = sorted(tuple(r) for r in joins.merged(spark.createDataFrame(rows, "k string, lo long, hi long"), ["k"], most=100).collect())
    want = []
    for k, lo, hi in sorted(r for r in rows if r[2] > r[1]):
        if want and want[-1][0] == k and lo <= want[-1][2]:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([k, lo, hi])
    assert got == [tuple(w) for w in want]
    assert len(plans["cuts"]) < 5000


def test_leak_locates_tiles_once(spark, monkeypatch):
    from strandlake.scratch import Scratch

    made, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: made.append(name) or save(self, df, name))
    tiles = spark.createDataFrame([(0, 0, 0, 0, 256, True), (1, 0, 0, 128, 384, False)], "asm_id int, contig_ix int, start0 long, ref_lo long, ref_hi long, train boolean")
    plan = edits.leak(None, 256, tiles)._jdf.queryExecution().optimizedPlan().toString()
    assert "hulls" in made and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert edits.leak(None, 256, tiles).first().bases_covered == 128
