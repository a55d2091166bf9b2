import hashlib
import math
import random

import numpy as np

from strandlake.llm import digest
from tests.llm.common import awkward, documents, prose

TABLES = [[hashlib.md5(f"{p}:{b}".encode()).digest()[0] for b in range(256)] for p in range(3)]


def brute_counts(data):
    out = [0] * 256
    for n, (i, j, k) in enumerate(digest.TRIPLETS):
        for s in range(len(data) - k):
            out[(TABLES[0][data[s + i]] ^ TABLES[1][data[s + j]] ^ TABLES[2][data[s + k]]) + 37 * n & 255] += 1
    return out


def brute_digest(data):
    c = brute_counts(data)
    s = sorted(c)
    q = s[63], s[127], s[191]
    body = [sum(x > y for y in q) for x in c]
    length = math.floor(math.log(len(data) + 1) / math.log(1.3) + 1e-9)
    packed = bytes(body[i] << 6 | body[i + 1] << 4 | body[i + 2] << 2 | body[i + 3] for i in range(0, 256, 4))
    return f"{length:02x}{15 * q[0] // max(q[2], 1):x}{15 * q[1] // max(q[2], 1):x}" + packed.hex()


def brute_likeness(a, b):
    body = lambda d: [x >> s & 3 for x in bytes.fromhex(d[4:]) for s in (6, 4, 2, 0)]
    w = (0, 1, 2, 6)
    far = sum(w[abs(x - y)] for x, y in zip(body(a), body(b))) / max(1, sum(w[max(x, y)] for x, y in zip(body(a), body(b))))
    head = lambda d: (int(d[:2], 16), int(d[2], 16), int(d[3], 16))
    return max(0.0, 1 - (far + sum(min(0.02 * max(abs(x - y) - 1, 0), 0.1) for x, y in zip(head(a), head(b)))) / 0.7)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (doc, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        new = t[: len(t) - k] + after[:k]
        f, e, g = (brute_digest(x.encode()) for x in (t, new, after))
        out.append((doc, len(t), hashlib.sha256(new.encode()).hexdigest(), f, e, round(brute_likeness(f, e), 9), round(brute_likeness(f, g), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, t[:40_000] if t else t) for i, t in awkward()]
    rows += [(1000 - 7 * i, prose(r.randrange(1, 120), i) + " é文\U0001f600" * (i % 3)) for i in range(60)]
    rows += [(500, "twice"), (500, "another"), (500, "twice")]
    assert got(digest.fingerprints(documents(spark, rows))) == brute(rows)
    assert got(digest.fingerprints(documents(spark, rows).repartition(3))) == brute(rows)


def test_one_and_none(spark):
    assert got(digest.fingerprints(documents(spark, [(5, "only one text")]))) == brute([(5, "only one text")])
    assert digest.fingerprints(documents(spark, [])).collect() == []
    assert digest.fingerprints(documents(spark, [])).columns == digest._NAMES


def test_hex_round_trip():
    _, d = digest._digested([b"", b"a", prose(500, 1).encode()])
    back = digest.Digests.parse(d.hex())
    assert (back.head == d.head).all() and (back.body == d.body).all()
    assert digest.likeness(d, back).tolist() == [1, 1, 1] and digest.likeness(d[:1], d[2:])[0] == 0


def test_small_groups_of_bytes(monkeypatch):
    texts = [prose(n, n).encode() for n in range(1, 40)]
    whole = digest.counts(texts)
    monkeypatch.setattr(digest, "TOGETHER", 64)
    assert (digest.counts(texts) == whole).all()


def test_edits_stay_near_and_others_far(spark):
    """On the driver's texts an edited text is nearer than the next document, and edits of a few words nearer still."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = digest.fingerprints(rows).toPandas()
    long = found[found.n_chars >= 200]
    assert (long.near_edited > long.near_next).mean() > 0.97
    assert long.near_edited.median() > 0.6 and long.near_next.median() < 0.4
    texts = [r.text for r in rows.where("length(text) > 2000").limit(50).collect()]
    _, a = digest._digested([t.encode() for t in texts])
    _, b = digest._digested([(t[:900] + " changed words here " + t[930:]).encode() for t in texts])
    assert np.median(digest.likeness(a, b)) > 0.9
