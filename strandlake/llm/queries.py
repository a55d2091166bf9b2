"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import digest, html, kmeans, knn, langid, minhash, mixing, ngram_lm, periodic, permutation, sharding, simhash, stages, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return simhash.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = knn.quality_scores(_table(spark, sf_dir, "documents"), stages.training_labels(_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= stages.QUALITY).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    return langid.identify(docs, docs.where(third != 1)).withColumn("held_out", third == 1)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(_table(spark, sf_dir, "pages")).records().drop("url")


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.neighbours(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ngram_lm.backoff_scores(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log2_score", 3).alias("log2_score"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(_table(spark, sf_dir, "embeddings"))


def op12_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a planted repetition where crc32 of the id ends in 0: from word a on, the p words at a over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(with_periods(_table(spark, sf_dir, "documents")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op1_mixing": op1_mixing, "op3_minhash_near_dedup": op3_minhash_near_dedup, "op4_sharding": op4_sharding, "op5_decontamination": op5_decontamination, "op8_quality": op8_quality, "op2_language_id": op2_language_id, "op6_permutation_index": op6_permutation_index, "op7_lm_scoring": op7_lm_scoring, "op9_warc": op9_warc, "op10_html_extraction": op10_html_extraction, "op11_centroid_clustering": op11_centroid_clustering, "op12_quartile_digest": op12_quartile_digest, "op13_periodic_runs": op13_periodic_runs}
ORACLE: dict[str, str] = {}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op3_minhash_near_dedup"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
kinds AS (SELECT min(doc_id) AS id, len(s) AS n, list_sort(s) AS s FROM sets GROUP BY ALL),
items AS (SELECT id, n, unnest(s) AS x FROM kinds),
near AS (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM kinds UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE l.c END AS component_id,
  CASE WHEN len(t.s) = 0 THEN true ELSE t.doc_id = l.c END AS kept
FROM sets t JOIN kinds k ON list_sort(t.s) = k.s JOIN least l ON l.a = k.id
"""

ORACLE["op1_mixing"] = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
kinds AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
  FROM sizes GROUP BY source),
fill AS (
  SELECT 0 AS turn, source, s, w, false AS full_, 1.5 * sum(s) OVER () AS open_, sum(w) OVER () AS rest FROM kinds
  UNION ALL
  SELECT turn + 1, source, s, w, f, 1.5 * sum(s) OVER () - sum(CASE WHEN f THEN 2.0 * s ELSE 0 END) OVER (),
    sum(CASE WHEN f THEN 0 ELSE w END) OVER ()
  FROM (SELECT *, full_ OR w * (open_ / rest) >= 2.0 * s AS f, count(*) OVER () AS k FROM fill WHERE rest > 0) WHERE turn < k),
level AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn DESC) AS last_ FROM fill) WHERE last_ = 1),
targets AS (SELECT source, s, CASE WHEN full_ THEN 2.0 * s ELSE w * (open_ / rest) END AS target FROM level),
placed AS (
  SELECT z.*, t.s, t.target, CAST(round(t.target) AS BIGINT) AS q,
    sum(size) OVER (PARTITION BY z.source ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS o
  FROM sizes z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
quotas AS (SELECT source, CAST(round(target) AS BIGINT) AS q, CAST(ceil(round(target) / 2048) AS BIGINT) AS slots FROM targets),
cuts AS (
  SELECT *, coalesce(CAST(sum(q) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / nullif(CAST(sum(q) OVER () AS DOUBLE), 0), 0) AS lo,
    CAST(sum(slots) OVER () AS BIGINT) AS total FROM quotas),
stretches AS (SELECT *, lead(lo, 1, 1.0::DOUBLE) OVER (ORDER BY source NULLS LAST) AS hi FROM cuts),
points AS (SELECT n, n * 0.6180339887498949::DOUBLE - floor(n * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range((SELECT max(total) FROM cuts))) AS n)),
ranked AS (SELECT source, slots, n, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS r FROM points JOIN stretches ON x >= lo AND x < hi),
had AS (SELECT c.source, c.slots, total, count(r.n) AS had FROM cuts c LEFT JOIN ranked r ON c.source IS NOT DISTINCT FROM r.source GROUP BY ALL),
short AS (SELECT source, total, unnest(range(had, slots)) AS r FROM had WHERE had < slots),
schedule AS (
  SELECT source, r, n AS position FROM ranked WHERE r < slots UNION ALL
  SELECT source, r, total + row_number() OVER (ORDER BY r, coalesce('=' || source, '')) - 1 FROM short)
SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(greatest(0, least(size, q - o)) + greatest(0, least(size, q - s - o)) AS BIGINT) AS taken, CAST(position AS BIGINT) AS position
FROM placed p LEFT JOIN schedule c ON size > 0 AND o < q AND c.source IS NOT DISTINCT FROM p.source AND c.r = o // 2048
"""

ORACLE["op7_lm_scoring"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
g AS (SELECT r, i, w AS c, lag(w) OVER o AS b, lag(w, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
k1 AS (SELECT c, count(*) AS n FROM g GROUP BY ALL), o1 AS (SELECT r, c, count(*) AS n FROM g GROUP BY ALL),
k2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL), o2 AS (SELECT r, b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
k3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL), o3 AS (SELECT r, a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL),
x AS (
  SELECT g.r, g.i, k1.n - o1.n AS n1, k2.n - o2.n AS n2, k3.n - o3.n AS n3, (SELECT count(*) FROM t) - l.m AS others
  FROM g JOIN k1 USING (c) JOIN o1 ON o1.r = g.r AND o1.c = g.c LEFT JOIN k2 ON k2.b = g.b AND k2.c = g.c
  LEFT JOIN o2 ON o2.r = g.r AND o2.b = g.b AND o2.c = g.c LEFT JOIN k3 ON k3.a = g.a AND k3.b = g.b AND k3.c = g.c
  LEFT JOIN o3 ON o3.r = g.r AND o3.a = g.a AND o3.b = g.b AND o3.c = g.c JOIN (SELECT r, count(*) AS m FROM t GROUP BY r) l ON l.r = g.r),
y AS (SELECT *, lag(n1) OVER o AS p1, lag(n2) OVER o AS p2, (CASE WHEN n1 > 0 THEN n1 ELSE 0.4::DOUBLE END) / greatest(others, 1) AS s1 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
z AS (SELECT *, CASE WHEN i < 1 THEN s1 WHEN n2 > 0 THEN n2 / p1 ELSE 0.4::DOUBLE * s1 END AS s2 FROM y),
f AS (SELECT r, sum(log2(CASE WHEN i < 2 THEN s2 WHEN n3 > 0 THEN n3 / p2 ELSE 0.4::DOUBLE * s2 END)) AS s, count(*) AS n FROM z GROUP BY r)
SELECT w.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_words, round(coalesce(f.s, 0), 3) AS log2_score FROM w LEFT JOIN f USING (r)
"""

ORACLE["op5_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM words),
grams AS (SELECT kind, id, len(w) AS n, list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')) AS g FROM split WHERE len(w) > 0),
each AS (SELECT DISTINCT kind, id, unnest(g) AS x FROM grams),
pairs AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM each d JOIN each i ON d.kind = 'd' AND i.kind = 'i' AND d.x = i.x),
windows AS (
  SELECT doc_id, item_id, s, i.g AS ig, d.g[s : s + least(len(i.g), len(d.g)) - 1] AS wg
  FROM pairs JOIN grams d ON d.kind = 'd' AND d.id = doc_id JOIN grams i ON i.kind = 'i' AND i.id = item_id,
  LATERAL (SELECT unnest(range(1, greatest(len(d.g) - len(i.g), 0) + 2)) AS s)),
scored AS (
  SELECT doc_id, item_id, s, shared / (len(wg) + len(ig) - shared) AS similarity
  FROM (SELECT *, list_sum(list_transform(list_distinct(wg), lambda x: least(len(list_filter(wg, lambda y: y = x)), len(list_filter(ig, lambda y: y = x))))) AS shared FROM windows))
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(s, (similarity, -s)) - 1 AS start_word FROM scored WHERE similarity >= 0.8 GROUP BY ALL
"""

ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


def _rounds(k: int, rounds: int) -> str:
    """The assignments a0 ... and the centroids c1 ... of each round, from the vectors v and the centroids c0."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    out = []
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT r, min(({square}, c.k)) AS m FROM v, c{t} c GROUP BY r)")
        if t < rounds:
            out.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(any_value(n.x), any_value(c.x)) AS x FROM c{t} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT m[2] AS k, i, CAST(sum(e) AS HUGEINT) AS s, count(*) AS n FROM (SELECT a{t}.m, unnest(v.x) AS e, unnest(range(64)) AS i FROM v JOIN a{t} USING (r)) GROUP BY ALL) GROUP BY k) n USING (k) GROUP BY c.k)""")
    return ",\n".join(out)


ORACLE["op11_centroid_clustering"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 8)),
{_rounds(8, 10)},
f AS (SELECT vec_id, m[2] AS k, m[1] AS d FROM v JOIN a10 USING (r))
SELECT vec_id, CAST(f.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN c10 c USING (k)
"""

# crc32 by its rule: eight steps of the polynomial make the table, a fold over the digits the value
_CRC = "".join(f"t{i + 1} AS (SELECT b, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM t{i}),\n" for i in range(8))

ORACLE["op13_periodic_runs"] = rf"""
WITH t0 AS (SELECT b, b AS c FROM range(256) r(b)),
{_CRC}crc AS (SELECT list(c ORDER BY b) AS c FROM t8),
ids AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^ 	-
]+') AS w FROM documents),
hashed AS (
  SELECT r, doc_id, coalesce(w, []) AS w, CAST(len(coalesce(w, [])) AS BIGINT) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda h, d: xor(h >> 8, c[(xor(h, d) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM ids, crc),
planned AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p, h % 10 = 0 AND n > 0 AS planted FROM hashed),
edited AS (SELECT r, doc_id, CASE WHEN coalesce(planted, false) THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM planned),
t AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM edited),
g AS (SELECT r, i, w || chr(1) || lead(w) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o || chr(1) || lead(w, 5) OVER o AS g FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
same AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND a.i < b.i),
isles AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
stretches AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 6 + q AS n FROM isles GROUP BY r, q, isle),
runs AS (SELECT r, s, n, min(q) AS q FROM stretches WHERE n >= greatest(12, 2 * q) GROUP BY r, s, n),
best AS (SELECT r, count(*) AS n_runs, max((n, -s, -q)) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS x FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-b[2] AS BIGINT) AS start, CAST(b[1] AS BIGINT) AS length, CAST(-b[3] AS BIGINT) AS period, CAST(1000 * b[1] // -b[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM edited LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

_BUCKETS = ", ".join(f"(xor(xor(a, {f'lead(b, {j}) OVER o'}), lead(c, {k}) OVER o) + {37 * n}) % 256" for n, (_, j, k) in enumerate(digest.TRIPLETS))
_LIKE = """greatest(0, least(1, 1 - (
  list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][abs({0}.c[i] - {1}.c[i]) + 1])) / CAST(greatest(1, list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][greatest({0}.c[i], {1}.c[i]) + 1]))) AS DOUBLE)
  + (least(0.02::DOUBLE * greatest(abs({0}.l - {1}.l) - 1, 0), 0.1::DOUBLE) + least(0.02::DOUBLE * greatest(abs({0}.u - {1}.u) - 1, 0), 0.1::DOUBLE) + least(0.02::DOUBLE * greatest(abs({0}.v - {1}.v) - 1, 0), 0.1::DOUBLE))) / 0.7::DOUBLE))"""

ORACLE["op12_quartile_digest"] = f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS r, count(*) OVER () AS m, doc_id, coalesce(text, '') AS t FROM documents),
nexts AS (SELECT d.r, d.m, d.doc_id, d.t, CAST(length(d.t) AS BIGINT) AS n, e.t AS after FROM docs d JOIN docs e ON e.r = d.r % d.m + 1),
texts AS (SELECT r, 0 AS e, t AS x FROM nexts UNION ALL SELECT r, 1, left(t, n - n // 4) || left(after, n // 4) FROM nexts),
tables AS (SELECT printf('%02X', b) AS h, ('0x' || substr(md5('0:' || b), 1, 2))::INT AS a, ('0x' || substr(md5('1:' || b), 1, 2))::INT AS b, ('0x' || substr(md5('2:' || b), 1, 2))::INT AS c FROM range(256) s(b)),
pairs AS (SELECT r, e, regexp_extract_all(hex(encode(x)), '..') AS p FROM texts),
bytes AS (SELECT r, e, unnest(p) AS h, unnest(range(len(p))) AS i FROM pairs),
triplets AS (SELECT r, e, [{_BUCKETS}] AS k FROM bytes JOIN tables USING (h) WINDOW o AS (PARTITION BY r, e ORDER BY i)),
counted AS (SELECT r, e, k, count(*) AS n FROM (SELECT r, e, unnest(k) AS k FROM triplets) WHERE k IS NOT NULL GROUP BY ALL),
rows_ AS (SELECT t.r, t.e, strlen(t.x) AS size, list(coalesce(n, 0) ORDER BY g.k) AS n FROM texts t CROSS JOIN (SELECT unnest(range(256)) AS k) g LEFT JOIN counted c ON c.r = t.r AND c.e = t.e AND c.k = g.k GROUP BY ALL),
ranked AS (SELECT *, list_sort(n) AS s FROM rows_),
digests AS (
  SELECT r, e, list_transform(n, lambda y: CAST(y > s[64] AS INT) + CAST(y > s[128] AS INT) + CAST(y > s[192] AS INT)) AS c,
    CAST(least(255, floor(ln(size + 1.0::DOUBLE) / ln(1.3::DOUBLE) + 1e-9::DOUBLE)) AS BIGINT) AS l, 15 * s[64] // greatest(s[192], 1) AS u, 15 * s[128] // greatest(s[192], 1) AS v FROM ranked),
f AS (SELECT *, printf('%02x%x%x', l, u, v) || array_to_string(list_transform(range(64), lambda i: printf('%02x', 64 * c[4 * i + 1] + 16 * c[4 * i + 2] + 4 * c[4 * i + 3] + c[4 * i + 4])), '') AS fp FROM digests)
SELECT d.doc_id, d.n AS n_chars, sha256(x.x) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, CAST({_LIKE.format('a', 'b')} AS DOUBLE) AS near_edited, CAST({_LIKE.format('a', 'z')} AS DOUBLE) AS near_next
FROM nexts d JOIN texts x ON x.r = d.r AND x.e = 1 JOIN f a ON a.r = d.r AND a.e = 0 JOIN f b ON b.r = d.r AND b.e = 1 JOIN f z ON z.r = d.r % d.m + 1 AND z.e = 0
"""
