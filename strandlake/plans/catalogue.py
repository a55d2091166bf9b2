"""Every registered query of the sequence engine and its SQL oracle, which works on whole documents and knows no blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators import chains, edits, fold, joins, kmers, timings, training
from strandlake.operators.cohort import Cohort
from strandlake.plans import datasets as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_BASES = f"regexp_replace(translate(lower(text), '{D.LETTERS}', '{('ACGT' * 8)[: len(D.LETTERS)]}'), '[^ACGT]', 'N', 'g')"
_RC = "reverse(translate({0}, 'ACGTacgt', 'TGCAtgca'))"
_BASE = f"""
base AS (SELECT doc_id, source, lang, {_BASES} AS fwd FROM documents),
asm AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS asm_id FROM (SELECT DISTINCT source FROM base))"""
_TEXT = f"""{_BASE},
contigs AS (
  SELECT asm_id, source AS assembly, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS contig_ix, doc_id, 'doc' || doc_id AS name,
    concat_ws(' ', 'doc' || doc_id, lang) AS header, CASE WHEN doc_id % 4 = 3 THEN {_RC.format('fwd')} ELSE fwd END AS seq, CAST(length(fwd) AS BIGINT) AS len,
    CAST(coalesce(sum(length(fwd)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS boff
  FROM base JOIN asm USING (source)),
streams AS (SELECT asm_id, assembly, string_agg(seq, '' ORDER BY contig_ix) AS seq, CAST(sum(len) AS BIGINT) AS n FROM contigs GROUP BY ALL)"""
_REF = f"""{_BASE},
ref AS (SELECT doc_id, fwd AS seq, CAST(length(fwd) AS BIGINT) AS len, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS contig_ix,
  CAST(coalesce(sum(length(fwd)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS boff FROM base WHERE source = '{D.REF}')"""
_MUTATED = f"""{_REF},
contigs AS (
  SELECT CAST(i AS INT) AS asm_id, contig_ix, len, array_to_string(list_transform(range(len), lambda p:
    CASE WHEN (p * 7919 + i * 104729) % 300 = 0 THEN translate(seq[p + 1], 'ACGT', 'TGCA') ELSE seq[p + 1] END), '') AS seq
  FROM ref, range({D.HAPLOTYPES}) t(i))"""
_PATTERNS = f"""
windows AS (
  SELECT item_id * 1000 + offs AS n, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS class, substr(seq, CAST(offs + 1 AS INT), 23) AS seq
  FROM (SELECT item_id, {_BASES} AS seq FROM benchmark) b, LATERAL (SELECT unnest(range(0, length(seq) - 22, 16)) AS offs)),
patterns AS (SELECT seq, min(n) FILTER (class = c) AS pid, c AS class FROM (SELECT *, min(class) OVER (PARTITION BY seq) AS c FROM windows WHERE regexp_matches(seq, '^[ACGT]+$')) GROUP BY seq, c)"""


def _kmers(table: str, k: int = 23) -> str:
    return f"kmers AS (SELECT *, substr(seq, CAST(pos + 1 AS INT), {k}) AS kmer FROM (SELECT *, unnest(range(greatest(length(seq) - {k - 1}, 0))) AS pos FROM {table}))"


_HITS = f"""hits AS (
  SELECT asm_id, contig_ix, pos, pid, class, 0 AS strand FROM kmers JOIN patterns p ON kmer = p.seq
  UNION ALL SELECT asm_id, contig_ix, pos, pid, class, 1 FROM kmers JOIN patterns p ON kmer = {_RC.format('p.seq')})"""
_GUIDES = """
sites AS (SELECT substr(kmer, 1, 20) AS spacer, (contig_ix * 7919 + pos * 104729) % 1000003 AS o, contig_ix, pos FROM kmers WHERE regexp_matches(kmer, '^[ACGT]+$') AND substr(kmer, 22, 2) = 'GG'),
guides AS (SELECT spacer, o * 1000 + pos % 1000 AS gid FROM (SELECT *, row_number() OVER (PARTITION BY spacer ORDER BY o, contig_ix, pos) AS i FROM sites) WHERE i = 1 ORDER BY o, contig_ix, pos, spacer LIMIT 40)"""
_LOWER = "array_to_string(list_transform(range(CAST({n} AS INT)), lambda j: CASE WHEN ({p} + j) % 100 BETWEEN 10 AND 29 AND ({p} + j) // 100 * 100 + 30 <= {total} THEN lower(({s})[CAST(j + 1 AS INT)]) ELSE ({s})[CAST(j + 1 AS INT)] END), '')"


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- metadata


@query(f"WITH {_TEXT} SELECT asm_id, assembly, contig_ix, name, header, len, boff FROM contigs")
def contig_table(spark, sf_dir):
    return D.world(spark, sf_dir).text.contigs.select("asm_id", "assembly", "contig_ix", "name", "header", "len", "boff")


@query(f"WITH {_TEXT} SELECT asm_id, assembly, count(*) AS contigs, CAST(sum(len) AS BIGINT) AS nbases, CAST((sum(len) + 1023) // 1024 AS BIGINT) AS nblocks, 1024 AS q FROM contigs GROUP BY ALL")
def assembly_info(spark, sf_dir):
    return D.world(spark, sf_dir).text.info()


@query(f"""WITH {_TEXT}, b AS (SELECT asm_id, unnest(range((n + 1023) // 1024)) AS block_ix, seq FROM streams)
SELECT asm_id, block_ix, block_ix * 1024 AS bstart, CAST(length(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS INT) AS blen, sha256(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS sha256 FROM b""")
def block_table(spark, sf_dir):
    return D.world(spark, sf_dir).text.blocks.select("asm_id", "block_ix", "bstart", "blen", "sha256")


@query(f"""WITH {_TEXT}, r AS (SELECT sum(n) AS a, sum((n + 1023) // 1024) * 16 AS b, sum(CASE WHEN n >= 30 THEN (n - 30) // 100 + 1 ELSE 0 END) * 16 AS c FROM streams),
d AS (SELECT count(*) * 24 + sum(strlen(header)) AS d FROM contigs), u AS (SELECT 'bases' AS component, a AS bytes FROM r UNION ALL SELECT 'block table', b FROM r UNION ALL SELECT 'case runs', c FROM r UNION ALL SELECT 'contigs', d FROM d)
SELECT component, CAST(bytes AS BIGINT) AS bytes FROM u UNION ALL SELECT 'total', CAST(sum(bytes) AS BIGINT) FROM u""")
def resident_bytes(spark, sf_dir):
    return D.world(spark, sf_dir).text.resident_bytes()


@query(f"WITH {_TEXT} SELECT asm_id, CAST(k * 100 + 10 AS BIGINT) AS start, CAST(20 AS BIGINT) AS len FROM (SELECT asm_id, unnest(range((n - 30) // 100 + 1)) AS k FROM streams WHERE n >= 30)")
def case_runs(spark, sf_dir):
    return D.world(spark, sf_dir).text.case_runs


@query(f"WITH {_TEXT} SELECT assembly, regexp_extract(assembly, '^(?:[^_]*_)?([^._]+)', 1) AS person FROM streams")
def individuals(spark, sf_dir):
    return D.world(spark, sf_dir).text.names().select("assembly", B.individual(F.col("assembly")).alias("person"))


# ---------------------------------------------------------------- windows by coordinate


def _requests(c: Cohort) -> DataFrame:
    n = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    return c.contigs.where("len > 64").select(F.col("name").alias("id"), "assembly", F.col("name").alias("contig"), (n * 37 % (F.col("len") - 50)).alias("start0"), F.lit(50).cast("long").alias("length"), (n % 2 == 1).alias("rc"))


_FETCH = f"""WITH {_TEXT}, r AS (SELECT c.*, doc_id * 37 % (len - 50) AS start0, s.n FROM contigs c JOIN streams s USING (asm_id) WHERE len > 64),
w AS (SELECT name AS id, assembly, name AS contig, start0, CAST(50 AS BIGINT) AS length, doc_id % 2 = 1 AS rc, boff, n, substr(seq, CAST(start0 + 1 AS INT), 50) AS u FROM r),
z AS (SELECT *, {_LOWER.format(n=50, p='boff + start0', total='n', s='u')} AS s FROM w)"""


@query(f"{_FETCH} SELECT id, assembly, contig, start0, length, rc, CASE WHEN rc THEN {_RC.format('s')} ELSE s END AS seq FROM z")
def fetch_regions(spark, sf_dir):
    c = D.world(spark, sf_dir).text
    return c.fetch(_requests(c))


@query(f"{_FETCH} SELECT id, assembly, contig, start0, length, rc, CASE WHEN rc THEN {_RC.format('s')} ELSE s END AS seq FROM z")
def fetch_colocated(spark, sf_dir):
    """The same requests over blocks stored in buckets: only requests are shuffled."""
    c = D.near(spark, sf_dir)
    return c.fetch(_requests(c))


@query(f"{_FETCH} SELECT id, translate(CASE WHEN rc THEN {_RC.format('u')} ELSE u END, 'ACGTN', '01234') AS tokens FROM z")
def fetch_tokens(spark, sf_dir):
    c = D.world(spark, sf_dir).text
    return c.fetch(_requests(c), tokens=True).select("id", F.col("seq").alias("tokens"))


@query(f"""{_FETCH}, q AS (SELECT id, assembly, contig || ':' || (start0 + 1) || '-' || (start0 + 50) AS region, s FROM z)
SELECT id, '>' || region || chr(10) || s || chr(10) AS fasta FROM q""")
def fetch_cli_regions(spark, sf_dir):
    c = D.world(spark, sf_dir).text
    region = F.concat("contig", F.lit(":"), F.col("start0") + 1, F.lit("-"), F.col("start0") + F.col("length"))
    return c.regions(_requests(c).select("id", "assembly", region.alias("region")))


@query(f"""WITH {_TEXT}, r AS (SELECT asm_id * 100 + i AS id, asm_id, (i * 7919 + asm_id * 104729) % (n - 2500) AS start, i % 2 = 1 AS rc, seq FROM streams, range(8) t(i) WHERE n > 2500)
SELECT id, asm_id, start, CAST(2500 AS BIGINT) AS length, rc, CASE WHEN rc THEN {_RC.format('substr(seq, CAST(start + 1 AS INT), 2500)')} ELSE substr(seq, CAST(start + 1 AS INT), 2500) END AS seq FROM r""")
def windows_stream(spark, sf_dir):
    """Windows over the stream, which cross blocks and contigs."""
    c = D.world(spark, sf_dir).text
    n = c.contigs.groupBy("asm_id").agg(F.sum("len").alias("n")).where("n > 2500")
    r = n.select("asm_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i"))
    r = r.select((F.col("asm_id") * 100 + F.col("i")).alias("id"), "asm_id", ((F.col("i") * 7919 + F.col("asm_id") * 104729) % (F.col("n") - 2500)).alias("start"), F.lit(2500).cast("long").alias("length"), (F.col("i") % 2 == 1).alias("rc"))
    return c.windows(r, case=False)


_DRAWN = "CAST('0x' || substr(md5(id || ' {0} {1}'), 1, 15) AS BIGINT)"
_SAMPLE = f"""WITH {_TEXT}, v AS (SELECT *, len - 255 AS valid, coalesce(sum(len - 255) OVER (ORDER BY asm_id, contig_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM contigs WHERE len >= 256),
u AS (SELECT id, {_DRAWN.format(7, 0)} % (SELECT sum(valid) FROM v) AS pos, {_DRAWN.format(7, 1)} % 100 < 50 AS rc FROM range(2000) t(id)),
s AS (SELECT id, asm_id, contig_ix, CAST(pos - lo AS BIGINT) AS start0, rc, substr(seq, CAST(pos - lo + 1 AS INT), 256) AS w FROM u JOIN v ON pos >= lo AND pos < lo + valid)"""


@query(f"{_SAMPLE} SELECT id, asm_id, contig_ix, start0, rc FROM s")
def sample_coordinates(spark, sf_dir):
    return D.world(spark, sf_dir).text.sample_coordinates(2000, 256, seed=7, rc_percent=50).select("id", "asm_id", "contig_ix", "start0", "rc")


@query(f"{_SAMPLE} SELECT id, asm_id, contig_ix, start0, rc, translate(CASE WHEN rc THEN {_RC.format('w')} ELSE w END, 'ACGTN', '01234') AS tokens FROM s")
def sample_windows(spark, sf_dir):
    rows = D.world(spark, sf_dir).text.sample(2000, 256, seed=7, rc_percent=50, tokens=True)
    return rows.select("id", "asm_id", "contig_ix", "start0", "rc", F.col("seq").alias("tokens"))


@query(f"{_SAMPLE}, b AS (SELECT (c.boff + s.start0 + 255) // 1024 - (c.boff + s.start0) // 1024 + 1 AS blocks FROM s JOIN contigs c USING (asm_id, contig_ix)) SELECT CAST(blocks AS BIGINT) AS blocks, count(*) AS windows FROM b GROUP BY ALL")
def blocks_touched(spark, sf_dir):
    rows = D.world(spark, sf_dir).text.sample_coordinates(2000, 256, seed=7, rc_percent=50)
    return rows.groupBy(B.blocks_touched(F.col("start"), F.col("length"), D.Q).alias("blocks")).agg(F.count("*").alias("windows"))


_MIX = _DRAWN.replace("{0} {1}", "5 {0}")


@query(f"""WITH {_TEXT}, v AS (SELECT *, coalesce(sum(len) OVER (ORDER BY asm_id, contig_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM contigs WHERE len > 0),
u AS (SELECT id, {_MIX.format(0)} % (SELECT sum(len) FROM v) AS pos, CAST(1 AS BIGINT) << CAST({_MIX.format(1)} % 20 AS INT) AS octave FROM range(1000) t(id)),
s AS (SELECT *, least(len, octave + {_MIX.format(2)} % octave) AS length FROM u JOIN v ON pos >= lo AND pos < lo + len)
SELECT id, assembly, name AS contig, {_MIX.format(3)} % (len - length + 1) AS start0, length, {_MIX.format(4)} % 2 = 1 AS rc FROM s""")
def sample_variable(spark, sf_dir):
    """Regions of lengths over many octaves, contigs weighted by length."""
    return D.world(spark, sf_dir).text.sample_variable(1000, seed=5)


@query(f"""WITH {_TEXT}, v AS (SELECT *, coalesce(sum(len) OVER (ORDER BY asm_id, contig_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM contigs WHERE len > 0),
u AS (SELECT id, {_MIX.format(0)} % (SELECT sum(len) FROM v) AS pos, 1 + CAST(floor(pow(2.0::DOUBLE, 20.0::DOUBLE * ({_MIX.format(1)} / 1152921504606846976.0::DOUBLE))) AS BIGINT) AS size FROM range(1000) t(id)),
s AS (SELECT *, least(len, size) AS length FROM u JOIN v ON pos >= lo AND pos < lo + len)
SELECT id, assembly, name AS contig, {_MIX.format(3)} % (len - length + 1) AS start0, length, {_MIX.format(4)} % 2 = 1 AS rc FROM s""")
def sample_log_uniform(spark, sf_dir):
    """Regions of log-uniform lengths, contigs weighted by length."""
    return D.world(spark, sf_dir).text.sample_variable(1000, seed=5, log_uniform=True)


@query(f"WITH {_TEXT} SELECT asm_id, md5(string_agg(name, ',' ORDER BY contig_ix)) AS selection_key, count(*) AS contigs FROM contigs WHERE len >= 500 GROUP BY asm_id")
def selection_keys(spark, sf_dir):
    """A key for the contigs of 500 bases and more of each assembly: the md5 of their names in order, a row a contig."""
    rows = D.world(spark, sf_dir).text.contigs.where("len >= 500").groupBy("asm_id")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("contig_ix", "name"))), lambda x: x["name"]), ",")
    return rows.agg(F.md5(names).alias("selection_key"), F.count("*").alias("contigs"))


@query(f"""WITH {_MUTATED.replace("WITH", "")}, c AS (SELECT DISTINCT 'c' || (c_custkey % 40) AS person FROM customer), p AS (SELECT DISTINCT 'c' || (asm_id * 5) AS person FROM contigs)
SELECT person FROM c INTERSECT SELECT person FROM p""")
def shared_people(spark, sf_dir):
    """Names that two sets of people share, each set's names once."""
    c = _rows(spark, sf_dir, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string")).alias("person"))
    p = D.world(spark, sf_dir).mutated.names().select(F.concat(F.lit("c"), (F.col("asm_id") * 5).cast("string")).alias("person"))
    return c.intersect(p)


@query(f"""WITH {_TEXT}, p AS (SELECT asm_id, unnest(range(0, n, 997)) AS pos FROM streams)
SELECT p.asm_id, p.pos, contig_ix, p.pos - boff AS start0 FROM p JOIN contigs c ON c.asm_id = p.asm_id AND p.pos >= boff AND p.pos < boff + len""")
def contig_of_position(spark, sf_dir):
    c = D.world(spark, sf_dir).text
    n = c.contigs.groupBy("asm_id").agg(F.sum("len").alias("n")).where("n > 0")
    points = n.select("asm_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(997).cast("long"))).alias("pos"))
    return c.contig_of(points)


# ---------------------------------------------------------------- reconstruction

_CASED = _LOWER.format(n="len", p="boff", total="n", s="seq")
_WHOLE = f"WITH {_TEXT}, c AS (SELECT c.*, s.n FROM contigs c JOIN streams s USING (asm_id)), z AS (SELECT asm_id, contig_ix, header, len, {_CASED.replace('seq', 'c.seq')} AS s FROM c)"


@query(f"{_WHOLE} SELECT asm_id, contig_ix, len, sha256(s) AS sha256, true AS complete FROM z")
def check_full(spark, sf_dir):
    return D.world(spark, sf_dir).text.check_full()


@query(f"{_WHOLE} SELECT asm_id, contig_ix, sha256('>' || header || chr(10) || regexp_replace(s, '(.{{1,60}})', '\\1' || chr(10), 'g')) AS sha256 FROM z")
def rebuild_fasta(spark, sf_dir):
    """Every record's FASTA text hashed as it streams by."""
    return D.world(spark, sf_dir).text.fasta_digests().drop("n")


@query(f"WITH {_TEXT} SELECT asm_id, base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT asm_id, base, length(seq) - length(replace(seq, base, '')) AS n FROM contigs, (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS base)) GROUP BY ALL")
def base_counts(spark, sf_dir):
    c = D.world(spark, sf_dir).text.decode(case=False)
    n = lambda b: F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))
    rows = c.select("asm_id", F.explode(F.array(*(F.struct(F.lit(b).alias("base"), n(b).cast("long").alias("n")) for b in "ACGTN"))).alias("x"))
    return rows.groupBy("asm_id", "x.base").agg(F.sum("x.n").alias("n"))


@query(f"{_FETCH}, t AS (SELECT id, sha256(CASE WHEN rc THEN {_RC.format('s')} ELSE s END) AS sha FROM z) SELECT id, sha AS sha256, true AS ok FROM t")
def answers_against_truth(spark, sf_dir):
    """Each answer's hash against that of the same region cut from the whole contig."""
    c = D.world(spark, sf_dir).text
    asked = _requests(c)
    whole = c.contig_sequences().select("asm_id", F.col("name").alias("contig"), F.col("seq").alias("whole")).join(joins.broadcast_if_small(c.names()), "asm_id").drop("asm_id")
    cut = asked.join(whole, ["assembly", "contig"]).withColumn("cut", F.substring("whole", (F.col("start0") + 1).cast("int"), F.col("length").cast("int")))
    truth = cut.select("id", F.sha2(F.when(F.col("rc"), B.reverse_complement(F.col("cut"))).otherwise(F.col("cut")), 256).alias("truth"))
    answers = c.fetch(asked).select("id", F.sha2("seq", 256).alias("sha256"))
    return answers.join(truth, "id").select("id", "sha256", (F.col("sha256") == F.col("truth")).alias("ok"))


def _scan(spark: SparkSession, sf_dir: str):
    """The text cohort written as FASTA and read again split by split, with its index."""
    from strandlake.scratch import new_path
    from strandlake.sources import fasta_scan

    key = (spark.sparkContext.applicationId, sf_dir, "scan")
    if key not in _cache:
        path, index = new_path(spark, "fasta"), new_path(spark, "index")
        D.world(spark, sf_dir).text.write_fasta(path)
        scan = fasta_scan.scan_fasta(spark, path, "*", folders=True)
        fasta_scan.write_index(scan, index)
        _cache[key] = (scan, index)
    return _cache[key]


@query(f"""WITH {_TEXT} SELECT assembly, CAST(contig_ix AS BIGINT) AS "order", header, len, CAST(least(len, 60) AS INT) AS line_width, sha256(seq) AS sha256 FROM contigs""")
def fasta_scan(spark, sf_dir):
    """Records of FASTA files that are read in splits, their bases hashed piece by piece."""
    scan, _ = _scan(spark, sf_dir)
    hashed = fold.sha256_in_order(scan.pieces, ["assembly", "order"], "start", "seq").drop("n")
    rows = scan.records.join(hashed, ["assembly", "order"], "left")
    return rows.select("assembly", "order", "header", "len", "line_width", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"))


@query(f"""WITH {_TEXT} SELECT asm_id, assembly, block_ix, sha256(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS sha256 FROM (SELECT *, unnest(range((n + 1023) // 1024)) AS block_ix FROM streams)""")
def fasta_scan_cohort(spark, sf_dir):
    """The blocks of a cohort built from pieces of such files."""
    scan, _ = _scan(spark, sf_dir)
    c = Cohort.from_pieces(scan.records, scan.pieces, D.Q, scan.case_runs)
    return c.blocks.join(joins.broadcast_if_small(c.names()), "asm_id").select("asm_id", "assembly", "block_ix", "sha256")


@query(f"""WITH {_TEXT}, p AS (SELECT assembly, CAST(contig_ix AS BIGINT) AS "order", name, unnest(range(0, len, 1000)) AS start, seq FROM contigs WHERE assembly = '{D.REF}' AND name <> 'doc0')
SELECT assembly, "order", name, start, sha256(substr(seq, CAST(start + 1 AS INT), 1000)) AS sha256 FROM p WHERE start < 3000""")
def fasta_source(spark, sf_dir):
    """Pieces of one assembly's contigs up to a place, read by index: the filters decide which bytes are."""
    from strandlake.sources import fasta_scan

    fasta_scan.register(spark)
    rows = spark.read.format("strandlake_fasta").option("path", _scan(spark, sf_dir)[1]).option("piece", 1000).load()
    rows = rows.where((F.col("assembly") == D.REF) & (F.col("start") < 3000) & (F.col("name") != "doc0"))
    return rows.select("assembly", "order", "name", "start", F.sha2("seq", 256).alias("sha256"))


# ---------------------------------------------------------------- exact search


@query(f"WITH {_PATTERNS.strip()} SELECT pid, class, seq FROM patterns")
def patterns(spark, sf_dir):
    return D.world(spark, sf_dir).patterns


@query(f"WITH {_PATTERNS.strip()}, s AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY pid * 7919 % 1000003, pid) AS i FROM patterns) SELECT class, pid FROM s WHERE i <= CASE class WHEN 'even' THEN 100 ELSE 20 END")
def pattern_sample(spark, sf_dir):
    """A capped sample of each class, in the order of a hash of the id."""
    rank = F.row_number().over(W.partitionBy("class").orderBy(F.col("pid") * 7919 % 1000003, "pid"))
    cap = F.when(F.col("class") == "even", 100).otherwise(20)
    return D.world(spark, sf_dir).patterns.withColumn("i", rank).where(F.col("i") <= cap).select("class", "pid")


_TEXT_HITS = f"WITH {_TEXT}, {_PATTERNS}, {_kmers('contigs')}, {_HITS}"
_MUTATED_HITS = f"WITH {_MUTATED}, {_PATTERNS}, {_kmers('contigs')}, {_HITS}"


@query(f"{_TEXT_HITS} SELECT asm_id, contig_ix, pos, pid, strand FROM hits")
def kmer_exact_hits(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.search(w.text, w.patterns)


@query(f"{_TEXT_HITS} SELECT asm_id, class, count(*) AS hits, count(DISTINCT pid) AS patterns FROM hits GROUP BY ALL")
def hits_by_class(spark, sf_dir):
    w = D.world(spark, sf_dir)
    hits = kmers.search(w.text, w.patterns).join(joins.broadcast_if_small(w.patterns.select("pid", "class")), "pid")
    return hits.groupBy("asm_id", "class").agg(F.count("*").alias("hits"), F.countDistinct("pid").alias("patterns"))


_LINE = "lpad(contig_ix::VARCHAR, 8, '0') || ':' || lpad(pos::VARCHAR, 12, '0') || ':' || lpad(pid::VARCHAR, 12, '0') || ':' || strand"


@query(f"{_TEXT_HITS} SELECT asm_id, count(*) AS hits, sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS digest FROM hits GROUP BY asm_id")
def hits_digest(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.digest(kmers.search(w.text, w.patterns), ["asm_id"])


@query(f"{_MUTATED_HITS} SELECT asm_id, contig_ix, pos, pid, strand FROM hits")
def hits_by_transfer(spark, sf_dir):
    """The reference scanned once and its hits carried through the edits, and the windows that no run holds scanned."""
    w = D.world(spark, sf_dir)
    return edits.search_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.patterns, _gaps(spark, sf_dir)).drop("origin")


#: 64 haplotypes, numbered in order of their names; 7919 * 179 is 1 mod 300, so the substitutions are those of one remainder. A window of 23
#: bases holds one of them at most, so each window is the reference's with a base changed
_MANY = f"""{_REF},
kmers0 AS (SELECT contig_ix, pos, substr(seq, CAST(pos + 1 AS INT), 23) AS kmer FROM (SELECT *, unnest(range(greatest(length(seq) - 22, 0))) AS pos FROM ref)),
people AS (SELECT CAST(row_number() OVER (ORDER BY 'y1_P' || (i // 2) || '.' || (i % 2 + 1)) - 1 AS INT) AS asm_id, (300 - i * 104729 * 179 % 300) % 300 AS f FROM range(64) s(i)),
placed AS (SELECT asm_id, contig_ix, pos, kmer, CAST((f - pos % 300 + 300) % 300 AS INT) AS o FROM kmers0, people),
whole AS (SELECT contig_ix, pos, asm_id, CASE WHEN o < 23 THEN substr(kmer, 1, o) || translate(substr(kmer, o + 1, 1), 'ACGT', 'TGCA') || substr(kmer, o + 2) ELSE kmer END AS kmer FROM placed)"""


@query(f"WITH {_MANY}, {_PATTERNS}, kmers AS (SELECT * FROM whole), {_HITS} SELECT asm_id, contig_ix, pos, pid, strand FROM hits")
def hits_of_many(spark, sf_dir):
    """64 haplotypes, by transfer."""
    w, m = D.world(spark, sf_dir), D.many(spark, sf_dir)
    return edits.search_by_transfer(m.cohort, w.reference, m.spans, w.patterns, m.gaps).drop("origin")


@query(f"{_TEXT_HITS} SELECT asm_id, contig_ix, pos, pid, strand FROM hits")
def hits_by_transfer_text(spark, sf_dir):
    """The same over the text cohort, most of which the reference doesn't hold, with runs on both strands."""
    w = D.world(spark, sf_dir)
    spans = edits.runs(w.text, _ops(spark, sf_dir, "text"))
    return edits.search_by_transfer(w.text, w.reference, spans, w.patterns).drop("origin")


@query(f"{_MUTATED_HITS} SELECT pid, count(*) AS total FROM hits GROUP BY pid")
def origin_totals(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return edits.origin_split(edits.search_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.patterns, _gaps(spark, sf_dir)), "pid").select("pid", "total")


@query()
def origin_split(spark, sf_dir):
    w = D.world(spark, sf_dir)
    from strandlake.scratch import Scratch

    # hits are read twice
    hits = Scratch(spark).save(edits.search_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.patterns, _gaps(spark, sf_dir)), "hits")
    return edits.origin_split(hits, "pid").join(edits.contexts(w.mutated, hits.drop("origin"), kmers.K), "pid")


_CONTEXTS = f"""{_TEXT_HITS}, x AS (SELECT pid, strand, substr(seq, CAST(greatest(pos - 20, 0) + 1 AS INT), CAST(least(pos + 43, len) - greatest(pos - 20, 0) AS INT)) AS c FROM hits JOIN contigs USING (asm_id, contig_ix))
SELECT pid, count(DISTINCT CASE WHEN strand = 1 THEN {_RC.format('c')} ELSE c END) AS unique_contexts FROM x GROUP BY pid"""


@query(_CONTEXTS)
def unique_contexts(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return edits.contexts(w.text, kmers.search(w.text, w.patterns), kmers.K)


@query(f"WITH {_REF}, {_PATTERNS}, {_kmers('ref')}, k AS (SELECT kmer, count(*) AS n FROM kmers WHERE kmer IN (SELECT seq FROM patterns UNION ALL SELECT {_RC.format('seq')} FROM patterns) GROUP BY kmer) SELECT p.seq, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS occurrences FROM patterns p LEFT JOIN k a ON a.kmer = p.seq LEFT JOIN k b ON b.kmer = {_RC.format('p.seq')}")
def kmerscan(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.kmer_counts(w.reference, w.patterns)


@query(f"WITH {_REF}, {_PATTERNS}, {_kmers('ref')} SELECT pid FROM patterns p WHERE seq NOT IN (SELECT kmer FROM kmers) AND {_RC.format('p.seq')} NOT IN (SELECT kmer FROM kmers)")
def absent_kmers(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return w.patterns.join(kmers.search(w.reference, w.patterns), "pid", "left_anti").select("pid")


@query(f"WITH {_REF}, {_kmers('ref', 8)} SELECT least(kmer, {_RC.format('kmer')}) AS canonical, count(*) AS n FROM kmers WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL")
def canonical_kmer_counts(spark, sf_dir):
    rows = kmers.extract(D.world(spark, sf_dir).reference, 8).where(B.is_acgt(F.col("kmer")))
    return rows.groupBy(B.canonical(F.col("kmer")).alias("canonical")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PATTERNS.strip()}, c AS (SELECT pid, seq, list_transform(['A', 'C', 'G', 'T'], lambda b: (length(seq) - length(replace(seq, b, ''))) / 23.0::DOUBLE) AS p FROM patterns),
e AS (SELECT pid, seq, list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * log2(x))) AS h FROM c),
s AS (SELECT pid, h, list_transform([1, 2, 3], lambda d: len(list_filter(range(d, 23), lambda i: seq[i + 1] = seq[i + 1 - d])) / (23.0::DOUBLE - d)) AS r FROM e)
SELECT pid, h < 1.5 OR r[1] >= 0.9 OR r[2] >= 0.9 OR r[3] >= 0.9 AS simple FROM s""")
def repeat_class(spark, sf_dir):
    return D.world(spark, sf_dir).patterns.select("pid", B.is_simple_repeat(F.col("seq"), kmers.K).alias("simple"))


# ---------------------------------------------------------------- guides

_SITES = f"""pam AS (
  SELECT asm_id, contig_ix, pos, 0 AS strand, substr(kmer, 1, 20) AS s FROM kmers2 WHERE regexp_matches(kmer, '^[ACGT]+$') AND substr(kmer, 22, 2) = 'GG'
  UNION ALL SELECT asm_id, contig_ix, pos, 1, substr({_RC.format('kmer')}, 1, 20) FROM kmers2 WHERE regexp_matches(kmer, '^[ACGT]+$') AND substr(kmer, 1, 2) = 'CC'),
found AS (SELECT asm_id, contig_ix, pos, gid, strand, CAST(hamming(s, spacer) AS INT) AS mm FROM pam, guides WHERE hamming(s, spacer) <= 4)"""


def _guide_sql(table: str, base: str) -> str:
    return f"WITH {base}, {_kmers('ref')}, {_GUIDES}, {_kmers(table).replace('kmers AS', 'kmers2 AS', 1)}, {_SITES}"


_MUTATED_SITES = _guide_sql("contigs", _MUTATED)


@query(f"WITH {_REF}, {_kmers('ref')}, {_GUIDES} SELECT gid, spacer FROM guides")
def guides(spark, sf_dir):
    return D.world(spark, sf_dir).guides


@query(f"{_MUTATED_SITES} SELECT asm_id, contig_ix, pos, gid, strand, mm FROM found")
def guide_sites(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.guide_sites(w.mutated, w.guides, 4)


@query(f"{_MUTATED_SITES} SELECT asm_id, contig_ix, pos, gid, strand, mm FROM found")
def guide_sites_by_transfer(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return edits.sites_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.guides, 4, _gaps(spark, sf_dir)).drop("origin")


@query(f"WITH {_MANY}, kmers AS (SELECT * FROM kmers0), {_GUIDES}, kmers2 AS (SELECT * FROM whole WHERE kmer LIKE '%GG' OR kmer LIKE 'CC%'), {_SITES} SELECT asm_id, contig_ix, pos, gid, strand, mm FROM found")
def guide_sites_of_many(spark, sf_dir):
    """64 haplotypes, by transfer."""
    w, m = D.world(spark, sf_dir), D.many(spark, sf_dir)
    return edits.sites_by_transfer(m.cohort, w.reference, m.spans, w.guides, 4, m.gaps).drop("origin")


@query(f"{_MUTATED_SITES} SELECT asm_id, contig_ix, pos, gid, strand, mm FROM found")
def guide_sites_by_seeds(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.seeded_sites(w.mutated, w.guides, 4)


@query(_guide_sql("(SELECT 0 AS asm_id, contig_ix, seq FROM ref)", _REF) + " SELECT asm_id, contig_ix, pos, gid, strand, mm FROM found")
def guide_refscan(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.guide_sites(w.reference, w.guides, 4)


@query(f"{_MUTATED_SITES} SELECT gid, mm, count(*) AS sites, count(DISTINCT asm_id) AS assemblies FROM found GROUP BY ALL")
def guide_mm_histogram(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return kmers.guide_sites(w.mutated, w.guides, 4).groupBy("gid", "mm").agg(F.count("*").alias("sites"), F.countDistinct("asm_id").alias("assemblies"))


@query(f"{_MUTATED_SITES} SELECT 'y1_P' || (asm_id // 2) || '.' || (asm_id % 2 + 1) AS assembly, 'doc' || doc_id AS contig, pos, gid, CASE strand WHEN 0 THEN '+' ELSE '-' END AS strand, mm FROM found JOIN ref USING (contig_ix)")
def guide_sites_named(spark, sf_dir):
    """Sites with the names of their assemblies and contigs."""
    w = D.world(spark, sf_dir)
    names = w.mutated.contigs.select("asm_id", "contig_ix", "assembly", F.col("name").alias("contig"))
    rows = kmers.guide_sites(w.mutated, w.guides, 4).join(joins.broadcast_if_small(names), ["asm_id", "contig_ix"])
    return rows.select("assembly", "contig", "pos", "gid", F.when(F.col("strand") == 0, "+").otherwise("-").alias("strand"), "mm")


@query(f"WITH {_TEXT}, {_kmers('contigs', 4)}, n AS (SELECT asm_id, kmer, count(*) AS n FROM kmers WHERE regexp_matches(kmer, '^[ACGT]+$') GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY asm_id, substr(kmer, 1, 3)) AS m FROM n) SELECT asm_id, CAST(sum(n) AS BIGINT) AS bases, round(sum(n * (log2(m) - log2(n))) / sum(n), 9) AS bits_per_base FROM t GROUP BY asm_id")
def bits_per_base(spark, sf_dir):
    """Under shares after the three bases before."""
    return kmers.bits_per_base(D.world(spark, sf_dir).text, 3).withColumn("bits_per_base", F.round("bits_per_base", 9))


@query()
def guide_origin(spark, sf_dir):
    w = D.world(spark, sf_dir)
    return edits.origin_split(edits.sites_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.guides, 4, _gaps(spark, sf_dir)), "gid")


@query()
def residual_kmers(spark, sf_dir):
    """Distinct sites that the reference doesn't hold, with what they are and where the first is."""
    w = D.world(spark, sf_dir)
    from strandlake.scratch import Scratch

    gaps = _gaps(spark, sf_dir)
    gone = edits.sites_by_transfer(w.mutated, w.reference, _spans(spark, sf_dir), w.guides, 4, gaps).where("origin = 'residual'").drop("origin")
    gone = Scratch(spark).save(gone, "hits")
    # a residual site lies in a gap, so its text is cut from the gaps' bases; no base of a cohort is a row
    return kmers.residual_guides(gone, kmers.texts_of(w.mutated, gone, gaps))


# ---------------------------------------------------------------- edits and coordinates

_cache: dict[tuple[str, str, str], DataFrame] = {}


def _ops(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, which)
    if key not in _cache:
        w = D.world(spark, sf_dir)
        _cache[key] = edits.align(getattr(w, which), w.reference)
        if which == "text":  # documents repeat themselves
            _cache[key] = chains.own_copies(w.text, _cache[key])
    return _cache[key]


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "spans")
    if key not in _cache:
        from strandlake.scratch import Scratch

        _cache[key] = Scratch(spark).save(edits.runs(D.world(spark, sf_dir).mutated, _ops(spark, sf_dir, "mutated")), "runs")
    return _cache[key]


# the mutated cohort's edits as the rule that made it tells them: a literal base at each substitution, copies between; what reads edits has an oracle over these
_KNOWN = f"""{_MUTATED},
subs AS (SELECT asm_id, boff + p AS g FROM (SELECT c.asm_id, r.boff, unnest(list_filter(range(c.len), lambda p: (p * 7919 + c.asm_id * 104729) % 300 = 0)) AS p FROM contigs c JOIN ref r USING (contig_ix))),
size AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM ref),
grid AS (SELECT CAST(a AS INT) AS asm_id, unnest(range((n + 1023) // 1024)) AS block_ix, n FROM size, range({D.HAPLOTYPES}) t(a)),
marks AS (SELECT asm_id, block_ix, -1 AS o, n FROM grid UNION ALL SELECT asm_id, g // 1024, g % 1024, n FROM subs, size UNION ALL SELECT asm_id, block_ix, least(1024, n - block_ix * 1024), n FROM grid),
gaps AS (SELECT *, lag(o) OVER (PARTITION BY asm_id, block_ix ORDER BY o) + 1 AS since, least(1024, n - block_ix * 1024) AS blen FROM marks),
pieces AS (
  SELECT asm_id, block_ix, 1 AS kind, since AS dst, o - since AS len, block_ix * 1024 + since AS src FROM gaps WHERE o > since
  UNION ALL SELECT asm_id, block_ix, 0, o, 1, 0 FROM gaps WHERE o >= 0 AND o < blen),
ops AS (SELECT asm_id, CAST(block_ix AS BIGINT) AS block_ix, CAST(row_number() OVER (PARTITION BY asm_id, block_ix ORDER BY dst) - 1 AS INT) AS op_ix, kind, CAST(dst AS INT) AS dst, CAST(len AS INT) AS len, CAST(src AS BIGINT) AS src FROM pieces)"""
_KNOWN_TILES = f"""{_KNOWN},
tiles AS (SELECT c.asm_id, contig_ix, unnest(range(0, c.len - 255, 256)) AS start0, r.boff FROM contigs c JOIN ref r USING (contig_ix) WHERE c.len >= 256),
ends AS (SELECT t.*, t.boff + start0 AS g, t.boff + start0 + 255 AS h FROM tiles t),
t AS (SELECT e.asm_id, contig_ix, start0, CASE WHEN a.g IS NULL THEN 1 ELSE 0 END AS cls_start, CASE WHEN b.g IS NULL THEN 1 ELSE 0 END AS cls_end, e.g AS lo, e.h + 1 AS hi
  FROM ends e LEFT JOIN subs a ON a.asm_id = e.asm_id AND a.g = e.g LEFT JOIN subs b ON b.asm_id = e.asm_id AND b.g = e.h),
good AS (SELECT * FROM t WHERE cls_start = 1 AND cls_end = 1)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "known")
    if key not in _cache:
        from strandlake.scratch import Scratch

        w = D.world(spark, sf_dir)
        _cache[key] = Scratch(spark).save(D.known_edits(w.mutated), "known")
    return _cache[key]


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "gaps")
    if key not in _cache:
        _cache[key] = edits.stored_gaps(D.world(spark, sf_dir).mutated, _spans(spark, sf_dir))
    return _cache[key]


@query(f"""WITH {_MUTATED}, s AS (SELECT asm_id, string_agg(seq, '' ORDER BY contig_ix) AS seq, sum(len) AS n FROM contigs GROUP BY asm_id), b AS (SELECT asm_id, unnest(range(CAST((n + 1023) // 1024 AS BIGINT))) AS block_ix, seq FROM s)
SELECT asm_id, CAST(block_ix AS BIGINT) AS block_ix, sha256(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS sha256 FROM b""")
def edits_executed(spark, sf_dir):
    """Every block from its edits and the reference."""
    rows = edits.execute(_ops(spark, sf_dir, "mutated"), D.world(spark, sf_dir).reference)
    return rows.select("asm_id", "block_ix", F.sha2("seq", 256).alias("sha256"))


@query(f"""WITH {_TEXT}, b AS (SELECT asm_id, unnest(range((n + 1023) // 1024)) AS block_ix, seq FROM streams)
SELECT asm_id, block_ix, sha256(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS sha256 FROM b""")
def edits_executed_text(spark, sf_dir):
    """The same of the text cohort, with copies within blocks."""
    rows = chains.execute(_ops(spark, sf_dir, "text"), D.world(spark, sf_dir).reference)
    return rows.select("asm_id", "block_ix", F.sha2("seq", 256).alias("sha256"))


@query()
def copy_statistics(spark, sf_dir):
    return edits.copy_statistics(_ops(spark, sf_dir, "text"))


@query()
def reference_runs(spark, sf_dir):
    return _spans(spark, sf_dir)


@query()
def jump_histogram(spark, sf_dir):
    return edits.jump_histogram(_ops(spark, sf_dir, "text"))


@query()
def generated_patterns(spark, sf_dir):
    """Test patterns by class of place: in literals, across run ends, short insertions, contig ends and block edges."""
    w = D.world(spark, sf_dir).text
    ops = _ops(spark, sf_dir, "text")
    return edits.generate_patterns(w, edits.pattern_candidates(w, ops, edits.runs(w, ops)), {"ref": 1000, "lit": 1000, "boundary": 200, "short_ins": 200, "contig_end": 200, "block_edge": 200, "self_copy": 200})


@query()
def literal_records(spark, sf_dir):
    return edits.literal_records(D.world(spark, sf_dir).text, _ops(spark, sf_dir, "text"))


@query()
def located_bases(spark, sf_dir):
    """All bases by class, their hops, and how many of those located have the base that the reference has there."""
    w = D.world(spark, sf_dir)
    return chains.located(w.text, chains.resolved(_ops(spark, sf_dir, "text")), w.reference)


@query(f"""WITH {_KNOWN} SELECT kind AS cls, CAST(sum(len) AS BIGINT) AS n, CAST(0 AS BIGINT) AS hops, CAST(CASE WHEN kind = 1 THEN sum(len) ELSE 0 END AS BIGINT) AS same FROM ops GROUP BY kind""")
def located_known(spark, sf_dir):
    """The same over the known edits."""
    w = D.world(spark, sf_dir)
    return chains.located(w.mutated, chains.resolved(_known(spark, sf_dir)), w.reference)


@query()
def tilemap(spark, sf_dir):
    return edits.tilemap(D.world(spark, sf_dir).mutated, _ops(spark, sf_dir, "mutated"), 256)


@query()
def leak_people(spark, sf_dir):
    w = D.world(spark, sf_dir).mutated
    return edits.leak(None, 256, edits.by_people(edits.tilemap(w, _ops(spark, sf_dir, "mutated"), 256), w.names(), seed=11))


@query()
def leak_locus(spark, sf_dir):
    w = D.world(spark, sf_dir).mutated
    return edits.leak(None, 256, edits.by_locus(edits.tilemap(w, _ops(spark, sf_dir, "mutated"), 256), 8192, seed=11))


@query()
def haplotype_coverage(spark, sf_dir):
    return edits.haplotype_coverage(D.world(spark, sf_dir).mutated, _spans(spark, sf_dir))


@query(f"WITH {_KNOWN} SELECT asm_id, block_ix, op_ix, kind, dst, len, src FROM ops")
def known_edits(spark, sf_dir):
    return _known(spark, sf_dir).drop("lit")


@query(f"""WITH {_KNOWN} SELECT CAST(sum(len) AS BIGINT) AS bases, round(100.0::DOUBLE * sum(CASE WHEN kind = 1 THEN len ELSE 0 END) / sum(len), 9) AS ref_percent, 0.0::DOUBLE AS rc_percent, 0.0::DOUBLE AS own_percent,
round(100.0::DOUBLE * sum(CASE WHEN kind = 0 THEN len ELSE 0 END) / sum(len), 9) AS lit_percent, count(*) FILTER (kind = 1) AS copies, round(sum(CASE WHEN kind = 1 THEN len ELSE 0 END) / CAST(count(*) FILTER (kind = 1) AS DOUBLE), 9) AS mean_copy FROM ops""")
def copy_shares(spark, sf_dir):
    rows = edits.copy_shares(_known(spark, sf_dir))
    return rows.select(*(F.round(c, 9).alias(c) if c not in ("bases", "copies") else F.col(c) for c in rows.columns))


@query(f"""WITH {_KNOWN}, w AS (SELECT *, coalesce(lag(kind) OVER b, -1) AS was, last_value(CASE WHEN kind = 1 THEN src + len END IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM ops WINDOW b AS (PARTITION BY asm_id, block_ix ORDER BY op_ix)),
f AS (SELECT 'kind' AS field, kind AS s, was, kind FROM w UNION ALL SELECT 'length', length(bin(CAST(len AS BIGINT))), was, kind FROM w UNION ALL SELECT 'jump', CASE WHEN near IS NULL THEN -1 ELSE length(bin(CAST(abs(src - near) AS BIGINT))) END, was, kind FROM w WHERE kind = 1),
x AS (SELECT field, s, 'none' AS context, 0 AS c FROM f UNION ALL SELECT field, s, 'kind before', was FROM f UNION ALL SELECT field, s, 'own kind', kind FROM f),
n AS (SELECT field, context, c, s, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY field, context, c) AS m FROM n)
SELECT field, context, CAST(sum(n) AS BIGINT) AS symbols, round(sum(n * (log2(m) - log2(n))), 3) AS bits FROM t GROUP BY ALL""")
def op_code_lengths(spark, sf_dir):
    """Bits that each field of the edits takes under several context models."""
    return edits.code_lengths(_known(spark, sf_dir)).withColumn("bits", F.round("bits", 3))


@query(f"WITH {_KNOWN_TILES} SELECT count(*) AS windows, count(*) FILTER (cls_start + cls_end = 2) AS both_ends, count(*) FILTER (cls_start + cls_end < 2) AS literal_end, CAST(0 AS BIGINT) AS span_off FROM t")
def tile_summary(spark, sf_dir):
    w = D.world(spark, sf_dir).mutated
    return edits.tile_summary(edits.tilemap(w, _known(spark, sf_dir), 256), 256)


_LEAK = """u AS (SELECT lo, hi, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM side WHERE train),
v AS (SELECT lo, hi, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM u), m AS (SELECT min(lo) AS lo, max(hi) AS hi FROM v GROUP BY run),
e AS (SELECT s.asm_id, s.contig_ix, s.start0, coalesce(sum(CASE WHEN m.lo IS NULL THEN 0 ELSE least(s.hi, m.hi) - greatest(s.lo, m.lo) END), 0) AS n FROM (SELECT * FROM side WHERE NOT train) s LEFT JOIN m ON s.lo < m.hi AND m.lo < s.hi GROUP BY ALL)
SELECT count(*) AS test_windows, count(*) FILTER (n >= 128) AS half, count(*) FILTER (n / 256.0 >= 0.9) AS ninety, count(*) FILTER (n = 0) AS zero, round(avg(n / 256.0::DOUBLE), 9) AS mean_share, round(median(n / 256.0::DOUBLE), 9) AS median_share, CAST(coalesce(sum(n), 0) AS BIGINT) AS bases_covered FROM e"""
_SEEDED = "CAST('0x' || substr(md5({key} || ' 11 0'), 1, 15) AS BIGINT)"


@query(f"""WITH {_KNOWN_TILES}, people AS (SELECT 'P' || i AS person, row_number() OVER (ORDER BY {_SEEDED.format(key="('P' || i)")}, 'P' || i) AS k, count(*) OVER () AS n FROM range({D.HAPLOTYPES} // 2) t(i)),
side AS (SELECT g.*, k <= n // 2 AS train FROM good g JOIN people ON person = 'P' || (asm_id // 2)), {_LEAK}""")
def leak_people_known(spark, sf_dir):
    """Half of the individuals, drawn with a seed, train."""
    w = D.world(spark, sf_dir).mutated
    return edits.leak(None, 256, edits.by_people(edits.tilemap(w, _known(spark, sf_dir), 256), w.names(), seed=11))


@query(f"""WITH {_KNOWN_TILES}, side AS (SELECT *, {_SEEDED.format(key="(lo // 8192)")} % 2 = 0 AS train FROM good WHERE lo // 8192 = (hi - 1) // 8192), {_LEAK}""")
def leak_locus_known(spark, sf_dir):
    """A seeded coin for each stretch of the reference."""
    w = D.world(spark, sf_dir).mutated
    return edits.leak(None, 256, edits.by_locus(edits.tilemap(w, _known(spark, sf_dir), 256), 8192, seed=11))


@query(f"WITH {_KNOWN} SELECT asm_id, n AS length, n - count(g) AS covered, round(1 - (n - count(g)) / CAST(n AS DOUBLE), 12) AS uncovered_share FROM size, subs GROUP BY asm_id, n")
def haplotype_coverage_known(spark, sf_dir):
    w = D.world(spark, sf_dir).mutated
    return edits.haplotype_coverage(w, edits.runs(w, _known(spark, sf_dir))).withColumn("uncovered_share", F.round("uncovered_share", 12))


# ---------------------------------------------------------------- intervals

_SPANS = "spans AS (SELECT l_suppkey AS k, l_partkey * 7 + l_linenumber AS lo, l_partkey * 7 + l_linenumber + CAST(l_quantity AS BIGINT) % 40 AS hi FROM lineitem)"
_UNION = f"""{_SPANS}, f AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans WHERE hi > lo),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM f), u AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, run)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.col("l_partkey") * 7 + F.col("l_linenumber")
    return _rows(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") % 40).alias("hi"))


@query(f"WITH {_UNION} SELECT k, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM u")
def interval_union(spark, sf_dir):
    return joins.merged(_intervals(spark, sf_dir), ["k"])


@query(f"""WITH {_UNION}, t AS (SELECT o_custkey % 100 + 1 AS k, o_orderkey AS id, o_orderkey % 14000 AS lo, o_orderkey % 14000 + 64 AS hi FROM orders)
SELECT t.id, CAST(coalesce(sum(CASE WHEN u.k IS NULL THEN 0 ELSE least(t.hi, u.hi) - greatest(t.lo, u.lo) END), 0) AS BIGINT) AS covered FROM t LEFT JOIN u ON t.k = u.k AND t.lo < u.hi AND u.lo < t.hi GROUP BY t.id""")
def interval_coverage(spark, sf_dir):
    union = joins.merged(_intervals(spark, sf_dir), ["k"]).select("k", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    lo = F.col("o_orderkey") % 14000
    t = _rows(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("k"), F.col("o_orderkey").alias("id"), lo.alias("lo"), (lo + 64).alias("hi"))
    hit = joins.overlap_join(t, union, ["k"], 64).groupBy("id").agg(F.sum(F.least("hi", "rhi") - F.greatest("lo", "rlo")).alias("covered"))
    return t.join(hit, "id", "left").select("id", F.coalesce("covered", F.lit(0)).alias("covered"))


@query(f"""WITH {_UNION.replace("l_suppkey AS k", "'all' AS k").replace("l_partkey * 7", "l_orderkey * 41")} SELECT k, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM u""")
def interval_union_one_key(spark, sf_dir):
    """One key for all: its ranges are merged by many tasks."""
    lo = F.col("l_orderkey") * 41 + F.col("l_linenumber")
    rows = _rows(spark, sf_dir, "lineitem").select(F.lit("all").alias("k"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") % 40).alias("hi"))
    return joins.merged(rows, ["k"], most=5_000)


@query(f"""WITH {_UNION}, c AS (SELECT k, CAST(sum(hi - lo) AS BIGINT) AS covered FROM u GROUP BY k)
SELECT s_suppkey AS k, CAST(15000 AS BIGINT) AS length, coalesce(covered, 0) AS covered, round(1 - coalesce(covered, 0) / 15000.0::DOUBLE, 12) AS uncovered_share FROM supplier LEFT JOIN c ON k = s_suppkey""")
def coverage_share(spark, sf_dir):
    """How much of each key's length its intervals leave uncovered."""
    lengths = _rows(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(15000).cast("long").alias("length"))
    return joins.covered(_intervals(spark, sf_dir), ["k"], lengths).withColumn("uncovered_share", F.round("uncovered_share", 12))


_TYPE = "(SELECT min(event_type) FROM events)"


@query(f"""WITH r AS (SELECT user_id, event_id AS "at", event_id * 3 AS value FROM events WHERE event_type = {_TYPE}), l AS (SELECT user_id, event_id AS pos FROM events WHERE event_type <> {_TYPE}),
b AS (SELECT user_id, pos, (SELECT max("at") FROM r WHERE r.user_id = l.user_id AND "at" <= pos) AS a, (SELECT min("at") FROM r WHERE r.user_id = l.user_id) AS f FROM l)
SELECT user_id, pos, coalesce(a, f) AS "at", coalesce(a, f) * 3 AS value FROM b""")
def as_of_anchor(spark, sf_dir):
    """The last anchor at or before each position, or the first one."""
    e = _rows(spark, sf_dir, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("t")))
    e = e.join(first)  # one row
    right = e.where("event_type = t").select("user_id", F.col("event_id").alias("at"), (F.col("event_id") * 3).alias("value"))
    return joins.as_of(e.where("event_type <> t").select("user_id", F.col("event_id").alias("pos")), right, ["user_id"], "value")


_ENTRIES = """r AS (SELECT l_suppkey AS k, l_partkey * 3 AS p, l_orderkey AS v, CAST(l_quantity AS BIGINT) * 5 AS n FROM lineitem WHERE l_linenumber = 1), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v, n) AS i FROM r),
l AS (SELECT o_custkey % 100 + 1 AS k, o_orderkey AS pos FROM orders WHERE o_orderkey % 3 = 0), m AS (SELECT l.k, pos, (SELECT max(i) FROM i WHERE i.k = l.k AND p <= pos % 6500) AS top FROM l)"""


@query(f"""WITH {_ENTRIES}, b AS (SELECT m.k, m.pos, max((n, i.i)) AS best FROM m JOIN i ON i.k = m.k AND i.i > top - 16 AND i.i <= top AND pos % 6500 < p + n GROUP BY m.k, m.pos),
c AS (SELECT m.k, m.pos, coalesce(best[2], top, 1) AS i FROM m LEFT JOIN b ON b.k = m.k AND b.pos = m.pos)
SELECT c.k, c.pos AS id, c.pos % 6500 AS pos, p AS "at", n AS len, v AS value FROM c LEFT JOIN i ON i.k = c.k AND i.i = c.i""")
def longest_containing(spark, sf_dir):
    """Of the last 16 entries at or before a position the longest that holds it."""
    right = _rows(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 3).alias("at"), F.col("l_orderkey").alias("value"), (F.col("l_quantity").cast("long") * 5).alias("len"))
    left = _rows(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 100 + 1).alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6500).alias("pos"))
    return joins.as_of_longest(left, right, ["k"])


# ---------------------------------------------------------------- timings

_TIMES = """times AS (SELECT l_returnflag AS label, [1, 8192, 65536][l_linenumber % 3 + 1] AS w, CAST(floor(l_extendedprice) AS BIGINT) + [20000, 26000, 60000][l_linenumber % 3 + 1] AS ns FROM lineitem),
dec AS (SELECT l_returnflag AS label, l_suppkey % 12 AS run, CAST(200000 AS BIGINT) AS bases, CAST(100000 + l_partkey AS BIGINT) AS ns FROM lineitem)"""
_P50 = "p50 AS (SELECT label, w, min(ns) FILTER (i >= (50 * n + 99) // 100) AS p50, min(ns) FILTER (i >= (95 * n + 99) // 100) AS p95, min(ns) FILTER (i >= (99 * n + 99) // 100) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY label, w ORDER BY ns) AS i, count(*) OVER (PARTITION BY label, w) AS n FROM times) GROUP BY label, w)"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), F.col("l_linenumber") % 3 + 1)
    return _rows(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), pick(1, 8192, 65536).alias("w"), (F.floor("l_extendedprice") + pick(20000, 26000, 60000)).alias("ns"))


@query(f"WITH {_TIMES}, {_P50} SELECT * FROM p50")
def latency_percentiles(spark, sf_dir):
    return timings.nearest_rank(_times(spark, sf_dir), ["label", "w"], "ns")


@query(f"""WITH {_TIMES}, {_P50}, d AS (SELECT label, median(bases / ns) AS d_q FROM dec WHERE run >= 3 GROUP BY label),
x AS (SELECT p.label, p.w, p.p50, d_q, o.p50 - 1024 / d_q AS c0 FROM p50 p JOIN p50 o ON o.label = p.label AND o.w = 1 JOIN d ON d.label = p.label), y AS (SELECT *, c0 + (w + 1023) / d_q AS t FROM x)
SELECT label, w, p50, round(c0, 6) AS c0, round(t, 6) AS predicted, round(100 * (t - p50) / p50, 6) AS error_pct, c0 >= 0 AND abs(100 * (t - p50) / p50) <= 20 AS pass FROM y""")
def window_law(spark, sf_dir):
    runs = _rows(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_suppkey") % 12).alias("run"), F.lit(200000).cast("long").alias("bases"), (F.col("l_partkey") + 100000).alias("ns"))
    rows = timings.window_law(_times(spark, sf_dir), timings.decode_rate(runs), D.Q)
    return rows.select("label", "w", "p50", F.round("c0", 6).alias("c0"), F.round("predicted", 6).alias("predicted"), F.round("error_pct", 6).alias("error_pct"), "pass")


@query(f"""WITH {_TIMES}, s AS (SELECT *, row_number() OVER (PARTITION BY label, w ORDER BY ns) AS i, count(*) OVER (PARTITION BY label, w) AS c FROM times)
SELECT label, w, count(*) AS n, median(ns) AS median, round(avg(ns), 4) AS mean, min(ns) AS least, max(ns) AS most, min(ns) FILTER (i = CAST(floor(0.9::DOUBLE * (c - 1)) AS BIGINT) + 1) AS p90 FROM s GROUP BY label, w""")
def bench_summary(spark, sf_dir):
    return timings.summary(_times(spark, sf_dir), ["label", "w"], "ns").withColumn("mean", F.round("mean", 4))


@query(f"WITH {_TIMES} SELECT label, median(ns) FILTER (w = 1) AS w1, median(ns) FILTER (w = 8192) AS w8192, median(ns) FILTER (w = 65536) AS w65536 FROM times GROUP BY label")
def bench_pivot(spark, sf_dir):
    rows = timings.pivot(_times(spark, sf_dir), "label", "w", [1, 8192, 65536], "ns")
    return rows.select("label", *(F.col(str(w)).alias(f"w{w}") for w in (1, 8192, 65536)))


@query(f"WITH {_TIMES} SELECT label, round(quantile_cont(ns, 0.9), 4) AS p, round(max(ns) / min(ns), 9) AS spread FROM times GROUP BY label")
def draw_spread(spark, sf_dir):
    rows = timings.interpolated(_times(spark, sf_dir), ["label"], "ns")
    return rows.select("label", F.round("p", 4).alias("p"), F.round("spread", 9).alias("spread"))


@query(f"WITH {_TIMES} SELECT label, round(regr_intercept(ns, w), 3) AS alpha, round(regr_slope(ns, w), 6) AS beta FROM times GROUP BY label")
def alpha_beta(spark, sf_dir):
    rows = timings.fit(_times(spark, sf_dir), ["label"], "w", "ns")
    return rows.select("label", F.round("alpha", 3).alias("alpha"), F.round("beta", 6).alias("beta"))


# ---------------------------------------------------------------- training views

_TOKENS = "list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 8 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 ELSE 9 END)"


@query(f"WITH {_TEXT} SELECT asm_id, contig_ix, name, CAST(len + 1 AS BIGINT) AS n_tokens, sha256(array_to_string(list_append({_TOKENS}, 12), ',')) AS sha256 FROM contigs")
def training_documents(spark, sf_dir):
    """The tokens' hash and number, piece by piece."""
    c = D.world(spark, sf_dir).text
    comma = F.when(F.col("at") > 0, F.lit(",")).otherwise(F.lit(""))
    pieces = training.token_pieces(c).select("asm_id", "contig_ix", "at", F.concat(comma, F.array_join("tokens", ",")).alias("text"), F.size("tokens").alias("k"))
    hashed = fold.sha256_in_order(pieces, ["asm_id", "contig_ix"], "at", "text").drop("n")
    n = pieces.groupBy("asm_id", "contig_ix").agg(F.sum(F.col("k").cast("long")).alias("n_tokens"))
    names = c.contigs.select("asm_id", "contig_ix", "name")
    return names.join(n, ["asm_id", "contig_ix"]).join(hashed, ["asm_id", "contig_ix"]).select("asm_id", "contig_ix", "name", "n_tokens", "sha256")


_DOCS = """d AS (SELECT row_number() OVER (ORDER BY asm_id, contig_ix) - 1 AS doc_ix, contigs.* FROM contigs)"""


def _token_requests(docs: DataFrame) -> DataFrame:
    """Two for each document: one that begins at a third of it and takes its end token, one of the 40 tokens, or what there is, from a place by its number."""
    third = F.floor(F.col("n_tokens") / 3)
    lo = F.col("doc_ix") * 101 % F.col("n_tokens")
    two = F.array(F.struct(F.lit(0).alias("k"), third.alias("offset"), (F.col("n_tokens") - third).alias("length")), F.struct(F.lit(1).alias("k"), lo.alias("offset"), F.least(F.lit(40).cast("long"), F.col("n_tokens") - lo).alias("length")))
    rows = docs.select("doc_ix", F.explode(two).alias("r"))
    return rows.select((F.col("doc_ix") * 2 + F.col("r.k")).alias("id"), "doc_ix", "r.offset", "r.length")


_GET = f"""WITH {_TEXT}, {_DOCS}, {{subset}}
q AS (SELECT *, len + 1 AS n, (len + 1) // 3 AS third, doc_ix * 101 % (len + 1) AS lo FROM s),
r AS (SELECT doc_ix * 2 AS id, doc_ix, third AS "offset", n - third AS length, seq, n FROM q UNION ALL SELECT doc_ix * 2 + 1, doc_ix, lo, least(40, n - lo), seq, n FROM q)
SELECT id, doc_ix, "offset", length, "offset" + length = n AS ends,
  sha256(array_to_string(list_transform(string_split(substr(seq || 'E', CAST("offset" + 1 AS INT), CAST(length AS INT)), ''), lambda c: CASE c WHEN 'A' THEN 8 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 WHEN 'E' THEN 12 ELSE 9 END), ',')) AS sha256 FROM r"""


@query(_GET.format(subset="s AS (SELECT * FROM d),"))
def training_get(spark, sf_dir):
    """Random access to documents' tokens, by number, offset and length."""
    c = D.world(spark, sf_dir).text
    rows = training.get(c, _token_requests(training.documents(c)))
    return rows.select("id", "doc_ix", "offset", "length", "ends", F.sha2(F.array_join("tokens", ","), 256).alias("sha256"))


@query(_GET.format(subset="s AS (SELECT * EXCLUDE (doc_ix), row_number() OVER (ORDER BY doc_ix) - 1 AS doc_ix FROM d WHERE len >= 2000),"))
def training_get_subset(spark, sf_dir):
    """The same over the documents of 2,000 bases and more, numbered anew."""
    c = D.world(spark, sf_dir).text
    some = training.documents(c).where("n_tokens > 2000")
    asked = _token_requests(some.withColumn("doc_ix", (F.row_number().over(W.orderBy("doc_ix")) - 1).cast("long")))
    rows = training.get(c, asked, some)
    return rows.select("id", "doc_ix", "offset", "length", "ends", F.sha2(F.array_join("tokens", ","), 256).alias("sha256"))


@query(f"""WITH {_TEXT}, s AS (SELECT string_agg(seq || 'E', '' ORDER BY asm_id, contig_ix) AS s, sum(len + 1) AS n FROM contigs),
r AS (SELECT row_ AS r, substr(s, CAST(row_ * 512 + 1 AS INT), 513) AS x FROM s, LATERAL (SELECT unnest(range(CAST((n - 1) // 512 AS BIGINT))) AS row_)),
k AS (SELECT r, x, list_transform(string_split(x, ''), lambda c: CASE c WHEN 'A' THEN 8 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 WHEN 'E' THEN 12 ELSE 9 END) AS t FROM r),
e AS (SELECT r, x, list_prepend(0, list_filter(range(1, 512), lambda i: x[i] = 'E')) AS cuts FROM r),
p AS (SELECT r, CAST(list_sum(list_transform(range(1, len(cuts) + 1), lambda j: ((CASE WHEN j < len(cuts) THEN cuts[j + 1] ELSE 512 END) - cuts[j]) * ((CASE WHEN j < len(cuts) THEN cuts[j + 1] ELSE 512 END) - cuts[j] - 1) // 2)) AS BIGINT) AS s FROM e)
SELECT r AS row, sha256(array_to_string(t[1:512], ',')) AS tokens, sha256(array_to_string(t[2:513], ',')) AS labels, CAST(512 - (length(substr(x, 1, 512)) - length(replace(substr(x, 1, 512), 'E', ''))) AS BIGINT) AS loss_places, s AS position_sum
FROM k JOIN p USING (r)""")
def training_batch(spark, sf_dir):
    rows = training.batches(D.world(spark, sf_dir).text, 512)
    total = lambda c, t: F.aggregate(c, F.lit(0).cast(t), lambda a, x: a + x).cast("long")
    return rows.select("row", F.sha2(F.array_join("tokens", ","), 256).alias("tokens"), F.sha2(F.array_join("labels", ","), 256).alias("labels"), total("loss_mask", "float").alias("loss_places"), total("position_ids", "int").alias("position_sum"))


# ---------------------------------------------------------------- archives


def _archive_rows(mutated: Cohort, ops: DataFrame) -> DataFrame:
    """``(assembly, fasta, edits)`` of a cohort: an archive is one file, so an assembly is one row from here on."""
    records = mutated.fasta_records().groupBy("asm_id").agg(F.array_sort(F.collect_list(F.struct("contig_ix", "record"))).alias("r"))
    records = records.select("asm_id", F.array_join(F.transform("r", lambda x: x["record"]), "").cast("binary").alias("fasta"))
    one = F.struct("op_ix", F.struct("kind", "dst", "len", "src").alias("op"))
    blocks = ops.groupBy("asm_id", "block_ix").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["op"]).alias("ops"))
    edits_ = blocks.groupBy("asm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "ops"))), lambda x: x["ops"]).alias("edits"))
    return records.join(edits_, "asm_id").join(mutated.names(), "asm_id").select("assembly", "fasta", "edits")


def _reference_bases(spark: SparkSession, sf_dir: str) -> bytes:
    """The format bounds a reference at 2^32 bases; the driver holds it to share it."""
    return b"".join(bytes(r.seq) for r in D.world(spark, sf_dir).reference.blocks.orderBy("block_ix").select("seq").toLocalIterator())


def _archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bytes]:
    from strandlake.scratch import Scratch
    from strandlake.sources import archive

    ref, key = _reference_bases(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir, "archives")
    if key not in _cache:
        _cache[key] = Scratch(spark).save(archive.encode_files(_archive_rows(D.world(spark, sf_dir).mutated, _ops(spark, sf_dir, "mutated")), ref, D.REF, D.Q), "archives")
    return _cache[key], ref


_SUMS = f"""WITH {_MUTATED}, f AS (SELECT c.asm_id, string_agg('>doc' || r.doc_id || ' ' || b.lang || chr(10) || regexp_replace(c.seq, '(.{{1,60}})', '\\1' || chr(10), 'g'), '' ORDER BY contig_ix) AS fasta
  FROM contigs c JOIN ref r USING (contig_ix) JOIN base b ON b.doc_id = r.doc_id GROUP BY c.asm_id)
SELECT 'y1_P' || (asm_id // 2) || '.' || (asm_id % 2 + 1) AS assembly, sha256(fasta) AS sha256 FROM f"""


@query(_SUMS)
def archive_roundtrip(spark, sf_dir):
    """Encoded, opened with every check, decoded: the source file again."""
    from strandlake.sources import archive

    files, ref = _archives(spark, sf_dir)
    return archive.decode_fasta(files, ref).select("assembly", F.sha2("fasta", 256).alias("sha256"))


@query(f"""WITH {_MUTATED}, s AS (SELECT asm_id, string_agg(seq, '' ORDER BY contig_ix) AS seq, sum(len) AS n FROM contigs GROUP BY asm_id), b AS (SELECT asm_id, unnest(range(CAST((n + 1023) // 1024 AS BIGINT))) AS block_ix, seq FROM s)
SELECT 'y1_P' || (asm_id // 2) || '.' || (asm_id % 2 + 1) AS assembly, CAST(block_ix AS BIGINT) AS block_ix, sha256(substr(seq, CAST(block_ix * 1024 + 1 AS INT), 1024)) AS sha256 FROM b""")
def archive_blocks(spark, sf_dir):
    from strandlake.sources import archive

    files, ref = _archives(spark, sf_dir)
    return archive.decode_blocks(files, ref).select("assembly", "block_ix", F.sha2("seq", 256).alias("sha256"))


@query()
def archive_headers(spark, sf_dir):
    from strandlake.sources import archive

    return archive.headers(_archives(spark, sf_dir)[0])


@query()
def archive_recode(spark, sf_dir):
    """A manifest over two block sizes, the mutated cohort cut and aligned at each."""
    from strandlake.sources import archive

    w, rows = D.world(spark, sf_dir), {}
    for q in (4096, 16384):
        mutated = Cohort.build(w.people[0], q, meta=w.people[1])
        rows[q] = _archive_rows(mutated, edits.align(mutated, w.reference))
    return archive.recode(rows, _reference_bases(spark, sf_dir), D.REF)


@query()
def corruption_matrix(spark, sf_dir):
    from strandlake.sources import archive

    files, ref = _archives(spark, sf_dir)
    return archive.corruption(files, ref, 10)
