import math
from collections import defaultdict

import pytest
from conftest import SF_SMALL

from freshstream.llm import mixing
from freshstream.llm.common import table


def brute(rows, weight):
    """rows: (source, place, tokens); weight: source -> weight.  Copies by (source, place)."""
    total, by = sum(r[2] for r in rows), defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = defaultdict(int)
    for s, own in by.items():
        tokens = sum(r[2] for r in own)
        if not tokens:
            continue
        quota = weight[s] * total
        passes = math.floor(quota / tokens + 1e-9)
        rest, at = quota - passes * tokens, 0
        for place in sorted({r[1] for r in own}):
            here = [r for r in own if r[1] == place]
            at += sum(r[2] for r in here)
            out[s, place] = passes + (at <= rest)
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("block_rows", [2, 128])
@pytest.mark.parametrize("entropy,repeats", [(0.95, 4.0), (1.0, 1.7), (1.0, 50.0)])
def test_mix_is_the_brute_force_one(spark, monkeypatch, block_rows, entropy, repeats):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(mixing, "SUPER", 4)
    docs = table(spark, SF_SMALL, "documents")
    extra = spark.createDataFrame([(None, "a b c", None, "s9", 1), (10**9, None, "x", None, 1),
                                   (10**9 + 1, "p q", "x", None, 1), (10**9 + 1, "p q", "x", None, 1),
                                   (10**9 + 2, "", "x", "empty", 1)],
                                  "doc_id long, text string, lang string, source string, weight int")
    docs = docs.withColumn("weight", docs.n_chars.cast("int")).select(
        "doc_id", "text", "lang", "source", "weight").union(extra)
    got = mixing.mix(docs, entropy, repeats).collect()
    rows = [(r.source, r.place, r.n) for r in docs.select(
        "source", mixing.place("doc_id", 17).alias("place"), mixing.token_count(docs.text).alias("n")).collect()]
    weight = {r.source: r._weight for r in got}
    tokens = defaultdict(int)
    for s, _, n in rows:
        tokens[s] += n
    assert "empty" not in weight
    total = sum(tokens.values())
    for s in tokens:        # tiny sources may have quota for no document
        weight.setdefault(s, 0.0)
    copies = defaultdict(int)
    places = {(r.source, r.doc_id): r.place for r in docs.select(
        "source", "doc_id", mixing.place("doc_id", 17).alias("place")).collect()}
    repeated = defaultdict(int)
    for s, p, _ in rows:
        repeated[s, p] += 1
    for r in got:
        copies[r.source, places[r.source, r.doc_id]] += 1
    want = brute(rows, weight)
    assert dict(copies) == {k: v * repeated[k] for k, v in want.items()}
    assert max(weight[s] * total / tokens[s] for s in tokens if tokens[s]) <= repeats + 1e-6


def test_temperature_meets_its_target(spark):
    per = spark.createDataFrame([(f"s{i}", 10, 10 ** (i % 5)) for i in range(9)],
                                "source string, docs long, tokens long")
    w = mixing.weights(per, target_entropy=0.8, max_repeats=1e9).collect()
    h = -sum(r.weight * math.log(r.weight) for r in w) / math.log(9)
    assert abs(h - 0.8) < 1e-6 and abs(sum(r.weight for r in w) - 1) < 1e-9
    w = mixing.weights(per, target_entropy=1.0, max_repeats=3.0).collect()
    assert max(r.quota / r.tokens for r in w) == pytest.approx(3.0, abs=1e-4)


def test_empty(spark):
    docs = table(spark, SF_SMALL, "documents").limit(0)
    assert mixing.mix(docs).count() == 0


def test_token_count(spark):
    texts = [(None, 0), ("", 0), (" ", 0), ("a", 1), (" a\t\nb ", 2), ("é b", 2), ("x\u00a0y", 1)]
    df = spark.createDataFrame(texts, "text string, n long")
    assert all(r.c == r.n for r in df.select("n", mixing.token_count(df.text).alias("c")).collect())


def test_default_target_is_met_where_sources_are_even(spark):
    per = spark.createDataFrame([(f"s{i}", 10, 1000 + 10 * i) for i in range(20)], "source string, docs long, tokens long")
    h = lambda w: -sum(r.weight * math.log(r.weight) for r in w if r.weight) / math.log(20)
    w = mixing.weights(per, max_repeats=50.0).collect()
    assert abs(h(w) - 0.9) < 1e-6 and max(r.quota / r.tokens for r in w) <= 50
    # here the default limit of repetitions binds first
    w = mixing.weights(per, target_entropy=0.5).collect()
    assert 0.5 < h(w) < 0.99 and max(r.quota / r.tokens for r in w) == pytest.approx(4.0, abs=1e-3)
    # equal sources: no power changes them
    per = spark.createDataFrame([(f"s{i}", 10, 1000) for i in range(20)], "source string, docs long, tokens long")
    assert [r.quota for r in mixing.weights(per).collect()] == pytest.approx([1000.0] * 20)
