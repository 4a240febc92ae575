import hashlib
import random

import numpy as np
from pyspark.sql import Row

from freshstream.llm import fingerprint as fp


def brute(text):
    raw, counts = text.encode(), [0] * fp.BUCKETS
    for i in range(len(raw) - 2):
        x = raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16
        counts[(x * 0x9E3779B1 % 2 ** 32) >> 25] += 1
    s = sorted(counts)
    q1, q2, q3 = s[31], s[63], s[95]
    bits = "".join(f"{(c > q1) + (c > q2) + (c > q3):02b}" for c in counts)
    return (int(bits, 2).to_bytes(32, "big").hex() + f"{min(255, round(8 * np.log2(1 + len(raw)))):02x}"
            + f"{15 * q1 // max(q3, 1):x}{15 * q2 // max(q3, 1):x}")


def sample(n=40):
    r = random.Random(2)
    return ["".join(r.choice("abc déß日 ") for _ in range(r.choice([0, 1, 2, 3, 50, 900]))) for _ in range(n)]


def test_digest_is_the_brute_force_one(monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 101)
    many = sample()
    assert fp.hexed(fp.digests(many)) == [brute(t) for t in many]


def test_likeness_bounds_and_order():
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda: " ".join(r.choice(words) for _ in range(400))
    a, b = text(), text()
    near = a.replace(a.split()[5], "changed", 1)
    d = fp.digests([a, near, b, ""])
    same, close, far, none = (fp.likeness(d[:1], d[i:i + 1])[0] for i in range(4))
    assert same == 1 and 0 <= none <= far < close < 1 and close > 0.9


def test_successors_over_partitions(spark):
    many = sample()
    rows = [Row(doc_id=3 * i, text=t, part="x") for i, t in enumerate(many)] + [
        Row(doc_id=7, text=None, part=None), Row(doc_id=None, text="zz", part=None)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(4)
    got = {r.doc_id: r for r in fp.with_successor(docs).collect()}
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, f, g = r.text or "", nxt.text or "", got[r.doc_id]
        half = len(t) // 2
        e = t[:len(t) - half] + f[:half]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (brute(t), brute(e))
        d = fp.digests([t, e, f])
        assert (g.near_edited, g.near_next) == (fp.likeness(d[:1], d[1:2])[0], fp.likeness(d[:1], d[2:])[0])
    one = fp.with_successor(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fp.with_successor(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs).count() == len(rows)
