"""Near-duplicate detection by b-bit MinHash.

Each document's shingle set gets 128 minima. Bands of four minima make candidates; the low four bits of every minimum,
packed into eight longs, give a collision-corrected estimate of the similarity by bit counts and throw out the
candidates that are clearly too far apart; what is left is compared on the full sets. Documents with equal sets are one
node from the start and bands are made of nodes, so groups of copies cost one node. Joins by a band, a hub, a set or a component,
any of which may have most of the rows, broadcast the few values that do (``skew.spread``). A pair at the threshold of 0.8 shares none of 32 bands with
probability 5e-8, and the estimate drops it with probability under 1e-8.

In a bucket, every node is compared with the bucket's smallest one only; then those that this left in other components
than it are compared with all of their bucket that are in other components than theirs, in tiles of bounded size, each pair
in the first band that it shares. A tile first has signatures alone; texts come only to the nodes that an estimate leaves near
another. It gives one link for each two components that it finds linked, no pairs. So no two nodes of a bucket stay apart untested.

Texts travel packed, a fraction of what their sets would take, and sets are made from them where they are compared. They are
stored in buckets of their nodes, so both comparisons fetch them by a join that shuffles the other side only.

Nodes are 64-bit fingerprints of sets: among n different sets, about n^2 / 2^65 pairs would be taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import text as tx
from strandlake.llm.components import components
from strandlake.llm.skew import spread
from strandlake.scratch import Scratch

HASHES, BITS, ROWS = 128, 4, 4
LONGS, BANDS = HASHES * BITS // 64, HASHES // ROWS
#: How far under the threshold an estimate may lie: six standard deviations of 128 draws at 0.8.
MARGIN = 0.22
#: Nodes on the two sides of a tile, and bytes of their sets, about.
OUT, ALL, TILE_BYTES = 512, 1024, 2**23
#: Sets that one hub's set is compared with in one sorted run.
RUN = 256


def shingle_set(data: bytes | None, width: int) -> np.ndarray:
    return np.unique(tx.ngrams(tx.hashed(tx.ascii_words(data or b"")), width))


def minima(items: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    rng = np.random.default_rng(20_011 + hashes)
    a, b = (rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    low, high = items.astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 2**32 - 1, np.uint32)
    step = 131_072 // hashes
    for k in range(0, len(items), step):
        out = np.minimum(out, (low[k : k + step, None] * a + high[k : k + step, None] * b).min(axis=0))
    return out


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each minimum, as many to a long as it holds."""
    part = (m & np.uint32(2**bits - 1)).astype(np.uint64).reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(part << (np.arange(part.shape[1], dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    bands = m.reshape(-1, ROWS).astype(np.uint64)
    out = np.arange(len(bands), dtype=np.uint64)
    for j in range(ROWS):
        out = tx.mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return out.view(np.int64)


def fingerprint(items: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())).view(np.int64)))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, fs = [], []
            keys, sigs = np.zeros((len(batch), BANDS), np.int64), np.zeros((len(batch), LONGS), np.int64)
            for i, data in enumerate(tx.binaries(batch.column(2))):
                items = shingle_set(data, width)
                ns.append(len(items))
                fs.append(fingerprint(items) if len(items) else None)
                if len(items):
                    m = minima(items)
                    keys[i], sigs[i] = band_keys(m), packed(m)
            lists = [pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1], x.ravel()) for x in (keys, sigs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(fs, pa.int64()), *lists], ["doc_id", "row", "n", "f", "bands", "sigs"])

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [None if x is None else pack.compress(x) for x in tx.binaries(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["row", "data"])


def _set_of(data: bytes, width: int) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(data), width)


def _agreeing(width: int):
    """Of ``(f, data)``, what has the set that f stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (_set_of(x, width) for x in batch.column(1).to_pylist())
            fine = [len(x) > 0 and fingerprint(x) == f for f, x in zip(batch.column(0).to_pylist(), sets, strict=True)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return run


def _near(table: pa.Table, percent: int, skip=None) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row of a tile and the others that it may be linked with; ``skip(i, own)`` tells which of them needn't be looked at."""
    key, left = table.column("key")[0].as_py(), table.column("left").to_numpy()
    f, c, out, n = (table.column(x).to_numpy() for x in ("f", "c", "out", "n"))
    bands, sigs = (table.column(x).combine_chunks().flatten().to_numpy().reshape(len(f), -1) for x in ("bands", "sigs"))
    ones, here = np.uint64(sum(1 << k for k in range(0, 64, BITS))), np.flatnonzero(~left)
    for i in np.flatnonzero(left).tolist():
        own = here[(c[here] != c[i]) & ~(out[here] & (f[here] < f[i]))]
        own = own[100 * np.minimum(n[own], n[i]) >= percent * np.maximum(n[own], n[i])]
        own = own[bands[i][(bands[own] == bands[i]).argmax(axis=1)] == key] if len(own) else own
        own = own[~skip(i, own)] if skip and len(own) else own
        off = (sigs[own] ^ sigs[i]).view(np.uint64)
        off = np.bitwise_count(reduce(np.bitwise_or, (off >> np.uint64(k) for k in range(BITS))) & ones).sum(axis=1)
        own = own[((HASHES - off) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS) >= percent / 100 - MARGIN]
        if len(own):
            yield i, own


def _met(percent: int):
    """The rows of a tile that an estimate leaves near another."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(len(table), bool)
        for i, own in _near(table, percent):
            some[i] = some[own] = True
        return table.filter(pa.array(some))

    return run


def _tile(percent: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        f, c = (table.column(x).to_numpy() for x in ("f", "c"))
        data, sets = table.column("data"), {}
        root = {int(x): int(x) for x in np.unique(c)}

        def top(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        def items(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _set_of(data[i].as_py(), width)
            return sets[i]

        a, b = [], []
        for i, own in _near(table, percent, lambda i, own: np.array([top(int(x)) == top(int(c[i])) for x in c[own]], bool)):
            mine = items(i)
            for j in own.tolist():
                x, y = top(int(c[i])), top(int(c[j]))
                if x == y:
                    continue
                small, large = sorted((mine, items(j)), key=len)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    root[max(x, y)] = min(x, y)
                    a.append(int(f[i]))
                    b.append(int(f[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _tiles(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Links ``(a, b)`` between components of a bucket, from ``mixed(key, f, c, out)``, ``nodes(f, n, bands, sigs)`` and ``texts(f, data)``."""
    own = scratch.save(nodes.join(mixed.select("f").distinct(), "f", "left_semi"), "own")
    sized = mixed.join(own.select("f", (F.col("n") * 8).alias("b")), "f")
    blocks = lambda n, b, most: (F.floor(F.greatest(n / most, b / TILE_BYTES)) + 1).cast("long")
    some = F.coalesce(F.sum(F.when(F.col("out"), F.col("b"))), F.lit(0))
    counts = sized.groupBy("key").agg(blocks(F.count_if("out"), some, OUT).alias("outs"), blocks(F.count("*"), F.sum("b"), ALL).alias("alls"), F.count("*").alias("rows"))
    rows = spread(mixed, scratch.save(counts, "counts"), "key", "rows")
    at = lambda n: F.pmod(F.xxhash64("f", F.lit(n)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("out").select("key", "f", "c", "out", F.lit(True).alias("left"), at("outs").alias("i"), every("alls").alias("j"))
    right = rows.select("key", "f", "c", "out", F.lit(False).alias("left"), at("alls").alias("j"), every("outs").alias("i"))
    both = left.unionByName(right).join(own, "f").select("key", "i", "j", "f", "c", "out", "left", "n", "bands", "sigs")
    met = scratch.save(both.groupBy("key", "i", "j").applyInArrow(_met(percent), both.schema), "met")
    return met.join(texts, "f").select(*met.columns, "data").groupBy("key", "i", "j").applyInArrow(_tile(percent, width), "a long, b long")


def _compare(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, items = None, None
        for batch in batches:
            a, b = [], []
            for h, f, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = _set_of(blob, width)
                if f == h:  # a hub comes before what is compared with it
                    hub, items = h, own
                elif hub == h:
                    small, large = (own, items) if len(own) < len(items) else (items, own)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * both >= percent * (len(own) + len(items) - both):
                        a.append(h)
                        b.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def estimate(x: str, y: str, hashes: int = HASHES, bits: int = BITS) -> Column:
    """The similarity from packed signatures: the share of equal parts, less what chance makes equal."""
    ones = sum(1 << k for k in range(0, 64, bits))
    fold = lambda d: F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (F.shiftright(d, k) for k in range(1, bits)), d).bitwiseAND(F.lit(ones)))
    off = reduce(lambda p, q: p + q, (fold(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(hashes * bits // 64)))
    chance = 2.0**-bits
    return ((hashes - off) / F.lit(float(hashes)) - chance) / (1 - chance)


def _sizes_near(x: str, y: str, percent: int) -> Column:
    """An exact bound: the similarity is at most the ratio of the sizes."""
    small, large = F.least(F.col(f"{x}n"), F.col(f"{y}n")), F.greatest(F.col(f"{x}n"), F.col(f"{y}n"))
    return small * 100 >= large * percent


def _mixed(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, f, c, out)`` of the buckets that hold several components; ``out`` if f's component isn't the hub's."""
    heads = members.groupBy("hub").agg(F.count("*").alias("rows")).join(labels, F.col("hub") == F.col("v"), "left")
    heads = scratch.save(heads.select("hub", F.coalesce("label", "hub").alias("hc"), "rows"), "heads")
    placed = members.join(labels, members.f == labels.v, "left").select("key", "hub", "f", F.coalesce("label", "f").alias("c"))
    placed = spread(placed, heads, "hub", "rows").select("key", "f", "c", (F.col("c") != F.col("hc")).alias("out"))
    placed = scratch.save(placed, "placed")
    mixed = placed.groupBy("key").agg(F.max("out").alias("off"), F.count("*").alias("k")).where("off and k > 1").select("key", "k")
    return spread(placed, scratch.save(mixed, "keys"), "key", "k")


def _row(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text, null ids too; those that agree in both are alike."""
    return F.xxhash64(doc_id, text)


def _likely(rows: DataFrame, need: DataFrame) -> DataFrame:
    """``rows(row, ..)`` less most of those that ``need(row)``, a saved table, lacks; none that it has goes.

    A bitmap of 16 bits for each row needed, up to 2^29 (64 MB), in pieces of 2^15 bits, is broadcast: it lets through one in 16 of the others.
    Beyond 2^25 rows needed it fills up and lets through more, and the join that follows does what it leaves.
    """
    bits = 2 ** min(max((16 * need.count()).bit_length(), 15), 29)
    place = lambda df: df.withColumn("__at", F.pmod("row", F.lit(bits))).withColumn("__piece", F.shiftright("__at", 15))
    pieces = place(need.select("row")).groupBy("__piece").agg(F.bitmap_construct_agg(F.col("__at").bitwiseAND(F.lit(2**15 - 1))).alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast((__at & 32767) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return place(rows).join(F.broadcast(pieces), "__piece").where((byte.bitwiseAND(F.expr("shiftleft(1, cast(__at & 7 as int))"))) != 0).select(*rows.columns)


def _texts(nodes: DataFrame, wanted: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(f, data)``, texts packed, for the nodes ``wanted(f)``: the row that stands for the node, and what agrees with it in id and text."""
    need = scratch.save(nodes.join(wanted.distinct(), "f").select("f", "row", "copies"), "need")
    rows = docs.select(_row(F.col("doc_id").cast("long"), F.col("text")).alias("row"), "text")
    rows = _likely(rows.where("text is not null"), need).mapInArrow(_packed_texts, "row long, data binary")
    return spread(rows, need, "row", "copies").select("f", "data")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Of ``pairs(a, b)``, those whose full sets are near enough, from ``texts(f, data)``."""
    counts = pairs.groupBy("a").agg((F.floor(F.count("*") / RUN) + 1).cast("int").alias("runs"), F.count("*").alias("pairs"))
    counts = scratch.save(counts, "runs")
    salts = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"))
    dealt = spread(pairs, counts, "a", "pairs").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("salt"))
    rows = salts.select("a", F.col("a").alias("b"), "salt").unionByName(dealt)
    rows = rows.join(texts, rows.b == texts.f).select("a", "b", "data", "salt", (F.col("a") != F.col("b")).alias("member"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").select("a", "b", "data")
    return scratch.save(rows.mapInArrow(_compare(percent, width), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Words are runs of other bytes than ASCII white space, with A-Z lower-cased; a document's set has its distinct runs of
    ``shingle`` words, or its whole sequence if that is shorter. Documents with ``100 * intersection >= percent * union``
    are linked; ``component_id`` is the smallest doc_id that links lead to, and ``kept`` says whether it is the row's own.

    A null or empty text, or one without words, has an empty set and is linked with nothing: it is its own component and
    kept. Rows that repeat a doc_id are linked like any others and all carry ``kept`` if theirs is the smallest id. A null
    doc_id counts as larger than all; its component_id is null, and it is kept, if no id is in its component. An empty
    table gives an empty result. Other columns are not looked at.
    """
    return classes(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """What ``near_duplicates`` returns, with the set's fingerprint ``f`` and the component's node ``c``, null for empty sets."""
    spark = docs.sparkSession
    tx.small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    kinds = "doc_id long, row long, n long, f long, bands array<long>, sigs array<long>"
    doc_id = F.col("doc_id").cast("long")
    sigs = scratch.save(docs.select(doc_id, _row(doc_id, F.col("text")).alias("row"), "text").mapInArrow(_signatures(shingle), kinds), "signatures")
    full = sigs.where("f is not null")
    # all from the same row, as one value: 42 of them make a method that the JVM compiles for seconds, and take more of its memory
    own = F.first(F.struct("row", "n", "bands", "sigs")).alias("own")
    nodes = full.groupBy("f").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("copies"), own)
    nodes = nodes.select("f", "min_id", "copies", "own.row", "own.n", "own.bands", *(F.col("own.sigs")[i].alias(f"s{i}") for i in range(LONGS)))
    nodes = scratch.save(nodes, "nodes")
    keys = nodes.select("f", "n", "bands", F.array(*(f"s{i}" for i in range(LONGS))).alias("sigs"))
    bands = keys.select("f", F.explode("bands").alias("key"))
    hubs = scratch.save(bands.groupBy("key").agg(F.min("f").alias("hub"), F.count("*").alias("rows")).where("rows > 1"), "hubs")
    members = scratch.save(spread(bands, hubs, "key", "rows").where("f <> hub"), "members")

    stars = members.select("hub", "f").distinct()
    signed = ["n", *(f"s{i}" for i in range(LONGS))]
    heads = nodes.select(F.col("f").alias("hub"), *(F.col(c).alias("h" + c) for c in signed))
    heads = scratch.save(stars.groupBy("hub").agg(F.count("*").alias("rows")).join(heads, "hub"), "heads")
    near = spread(stars.join(nodes.select("f", *signed), "f"), heads, "hub", "rows")
    near = near.where(_sizes_near("h", "", percent) & (estimate("h", "") >= percent / 100 - MARGIN))
    near = scratch.save(near.select(F.col("hub").alias("a"), F.col("f").alias("b")), "pairs")
    # the texts of all nodes that share a band, one each, in buckets of the node: joins by it don't shuffle them again
    wanted = members.select(F.col("hub").alias("f")).union(members.select("f"))
    made = _texts(nodes, wanted, docs, scratch).mapInArrow(_agreeing(shingle), "f long, data binary").dropDuplicates(["f"])
    texts = scratch.save_by(made, "texts", "f", int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = _verified(near, texts, percent, shingle, scratch)
    labels = components(links, scratch)

    mixed = scratch.save(_mixed(members, labels, scratch), "mixed")
    more = scratch.save(_tiles(mixed, keys, texts, percent, shingle, scratch), "more")
    scratch.drop(mixed, texts)
    if not more.isEmpty():
        labels = components(links.union(more), scratch)

    tops = nodes.join(labels, nodes.f == labels.v, "left").select("f", "min_id", "copies", F.coalesce("label", "f").alias("c"))
    least = scratch.save(tops.groupBy("c").agg(F.min("min_id").alias("component_id"), F.count("*").alias("nodes")), "least")
    found = scratch.save(spread(tops, least, "c", "nodes").select("f", "c", "component_id", "copies"), "found")
    some = spread(sigs.select("doc_id", "n", "f"), found, "f", "copies").select("doc_id", "n", "f", "c", "component_id")
    none = sigs.where("f is null").select("doc_id", "n", "f", F.lit(None).cast("long").alias("c"), F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "f", "c")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, with all their columns, less all but one of each component.

    The row with the smallest doc_id stays. Where rows repeat that id, one of those with the smallest fingerprint stays.
    Rows with an empty set all stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(classes(docs, shingle, percent), "classes")
    chosen = rows.where("kept and f is not null").groupBy("c", "doc_id").agg(F.min("f").alias("f")).select("doc_id", "f")
    chosen = chosen.union(rows.where("f is null").select("doc_id", "f")).distinct()
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    chosen = scratch.save(chosen.select(F.col("doc_id").alias("__id"), F.col("f").alias("__f")), "chosen")
    repeated = scratch.save(counts.where("rows > 1").select(F.col("doc_id").alias("__id")), "repeated")
    once = chosen.select("__id").distinct().join(repeated.select(F.col("__id").alias("__r")), F.col("__id").eqNullSafe(F.col("__r")), "left_anti")
    out = docs.join(once, docs.doc_id.eqNullSafe(once["__id"]), "left_semi")
    if repeated.isEmpty():
        return out
    names = docs.columns
    kinds = T.StructType([*docs.schema.fields, T.StructField("__f", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in tx.binaries(batch.column(names.index("text")))]
            marks = pa.array([fingerprint(x) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], [*names, "__f"])

    more = docs.join(repeated, docs.doc_id.eqNullSafe(repeated["__id"]), "left_semi").mapInArrow(marked, kinds)
    fine = chosen.select("__id", F.col("__f").alias("__g"))
    more = more.join(fine, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__f").eqNullSafe(F.col("__g")), "left_semi")
    same = more.where("__f is not null").dropDuplicates(["doc_id", "__f"])
    return out.unionByName(same.drop("__f")).unionByName(more.where("__f is null").drop("__f"))
