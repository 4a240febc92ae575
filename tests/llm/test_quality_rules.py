"""Quality rules against a plain-Python model, rules and ratio alike."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from conftest import SF_MID
from freshstream.llm import quality_rules as Q
from freshstream.llm.queries import QUERIES

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def facts(text):
    text = text or ""
    w = words(text)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    inside = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def slots(text, buckets):
    w = [x.encode() for x in words(text)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = [xxhash.xxh64(x, seed=42).intdigest() for x in w]
    two = [xxhash.xxh64(b, seed=one[i]).intdigest() for i, b in enumerate(w[1:])]
    return [signed(h) % buckets for h in one + two]


def model(docs, trusted, buckets=Q.BUCKETS, pseudo=1.0, quantile=0.005, slack=1.0):
    """{doc_id: facts, base_failed, score, kept} of rows (doc_id, text)."""
    raw, target = np.full(buckets, pseudo), np.full(buckets, pseudo)
    for doc_id, text in docs:
        for s in slots(text, buckets):
            raw[s] += 1
            target[s] += trusted.get(doc_id) is True
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ratio = np.rint(ratio * 1e6).astype("int64") if target.sum() > pseudo * buckets else np.zeros(buckets, "int64")
    out = []
    for doc_id, text in docs:
        f, g = facts(text), slots(text, buckets)
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        out.append([doc_id, f, failed, ratio[g].sum() / len(g) / 1e6 if g else 0.0])
    held = [r[3] for r in out if trusted.get(r[0]) is False and not r[2]]
    low, mid = (np.quantile(held, quantile), np.quantile(held, 0.5)) if held else (-np.inf, 0.0)
    bound = low - slack * (mid - low) if held else -np.inf
    return [(*r, not r[2] and r[3] >= bound) for r in out]


def check(spark, folder, tolerate=0):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trusted = {r.t_id: r.fit for r in Q.trusted_ids(labels, "doc_id", "quality", 200_000).collect()}
    want = sorted(model([tuple(r) for r in docs.select("doc_id", "text").collect()], trusted), key=repr)
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed,
                   r.score, r.kept) for r in QUERIES["op13_hashed_ratio"](spark, folder).collect()), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    assert sum(g[4] != w[4] for g, w in zip(got, want)) == 0
    return got


def test_query_equals_model_on_all_documents(spark):
    got = check(spark, SF_MID)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    good = [r[4] for r in got if labels.get(r[0]) == 1 and not r[2]]
    junk = [r[4] for r in got if labels.get(r[0]) == 0]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.15 * len(junk)


def test_edges(spark, workdir):
    """NULLs, empty, one and two words, repeated rows and lines, long texts,
    several labels, clashing columns."""
    texts = [None, "", "one", "one two", "a b c a b c", "x " * 60, "\n\n \nq\nq\n q\nq", "# * <>|$%&é\U0001F600",
             " ".join(f"w{i % 977}" for i in range(30_000)), " ".join(f"u{i}" for i in range(70)),
             "p q r " * 10 + " ".join(f"v{i}" for i in range(31)), "\t\x0b\x0ca b c\x0d"]
    rows = [(i % 9, t) for i, t in enumerate(texts * 3)] + [(None, texts[8]), (None, None)]
    spark.createDataFrame([(*r, 1, "s", 0.5) for r in rows],
                          "doc_id bigint, text string, slot int, slots string, score double") \
        .write.parquet(f"{workdir}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, None), (3, 0), (8, 1), (8, 1), (5, 1), (6, 1), (7, 1), (None, 1)],
                          "doc_id bigint, quality int").write.parquet(f"{workdir}/labels.parquet")
    check(spark, workdir)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(70))), (2, "few")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.doc_id: r.kept for r in Q.judge(docs, none).collect()} == {1: True, 2: False}
    assert Q.judge(docs.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    plan = Q.with_facts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["a b c d a b c", "a a a a", "a b c x a b c b c d", "b c d b c d b"])
def test_repeated_windows_overlap(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(Q.repeated_words(Q.words_of(df.t)).alias("n")).first().n == facts(text)[4]


def test_every_trusted_document_counts(spark, monkeypatch):
    """Beyond 200,000 too, with the ids broadcast or not."""
    labels = spark.range(250_000).selectExpr("id AS doc_id", "1 AS quality")
    ids = Q.trusted_ids(labels, "doc_id", "quality")
    assert ids.count() == 250_000
    docs = spark.range(0, 500_000, 7).withColumnRenamed("id", "doc_id")
    assert Q.among(docs, ids).count() == 35_715
    monkeypatch.setattr("freshstream.operators.joins.bounded_broadcast.__defaults__", (10, 10))
    assert Q.among(docs, ids).count() == 35_715


@pytest.mark.parametrize("n", [0, 1, 2, 401])
def test_quantiles_are_exact(spark, n):
    rows = spark.createDataFrame([(((i * 37) % 101 - 50) / 777,) for i in range(n)], "score double")
    got = Q.quantiles(rows, "score", (0.005, 0.5))
    want = rows.selectExpr("percentile(score, array(0.005, 0.5)) AS p").first()["p"] or [None, None]
    assert got == want
