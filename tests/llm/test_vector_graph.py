import math

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL

from freshstream.llm import vector_graph as vg
from freshstream.llm.common import table


def brute(rows, cosine=0.9):
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.array([np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else np.zeros(len(rows[0][1]))
                  for (_, v), o in zip(rows, ok)])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = vg.roots(near)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [e for (e, _), r in zip(rows, root) if r == root[i] and e is not None]
        c = (min(ids) if ids else None) if ok[i] else d
        out.append((d, int(near[i].sum()), c, d is not None and d == c))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def groups(seed=1, n=300):
    r = np.random.default_rng(seed)
    out = [r.normal(size=16) for _ in range(n)]
    out += [out[3] + r.normal(size=16) * 0.12 for _ in range(150)] + [out[9] + r.normal(size=16) * 0.1 for _ in range(4)]
    out += [out[5]] * 40 + [-out[5], 3 * out[7]]
    return [np.asarray(v, "float32").tolist() for v in out]


@pytest.mark.parametrize("shard", [1200, 60])
def test_links_are_the_brute_force_ones(spark, monkeypatch, shard):
    monkeypatch.setattr(vg, "SHARD_ROWS", shard)
    monkeypatch.setattr(vg, "MEAN_ROWS", 100)
    monkeypatch.setattr(vg, "CHUNK", 50)
    monkeypatch.setattr(vg, "SMALL", 20)
    monkeypatch.setattr(vg, "BRIDGES", 20)
    rows = [(7 * i % 1009, v) for i, v in enumerate(groups())]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 15 + [None]), (2003, [float("nan")] + [1.0] * 15),
             (2004, [float("inf")] * 16), (None, rows[5][1]), (None, [1.0] + [0.0] * 15), (2005, [1.0, 2.0, 3.0]), rows[2]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string")
    got = order(vg.links(docs.repartition(3)).collect())
    short = [(d, v if v is None or len(v) == 16 else None) for d, v in rows]
    want = order(brute(short))
    assert [g[:2] for g in got] == [w[:2] for w in want] and got == want


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_embeddings(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert order(vg.links(df).collect()) == order(brute(rows))


def test_empty(spark):
    assert vg.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_recall_of_the_graph_alone():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 12))
    x[100:220] = x[0] + r.normal(size=(120, 12)) * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = x @ x.T
    adj = vg.robust_prune(sim)
    assert (adj >= 0).sum(axis=1).max() <= vg.DEGREE
    got = vg.range_search(sim, adj, int(np.argmax(sim.sum(axis=1))), 0.9)
    assert (got & (sim >= 0.9)).sum() >= 0.97 * (sim >= 0.9).sum() and not (got & (sim < 0.9)).any()


def unit(rows):
    x = np.asarray(rows, float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_all_pairs_of_a_large_shard_and_of_its_visitors_are_found(spark, monkeypatch):
    monkeypatch.setattr(vg, "CHUNK", 16)
    r = np.random.default_rng(4)
    x = unit(r.normal(size=(120, 16)))
    x = unit(np.concatenate([x, x + r.normal(size=x.shape) * 0.03]))      # 120 isolated pairs
    shards = spark.createDataFrame([(7, i, v.tolist(), i >= 200) for i, v in enumerate(x)],
                                   "cluster int, node long, vec array<double>, guest boolean")
    got = {(r.a, r.b) for r in vg.search(shards, 0.9).collect()}
    assert got == {(i + 120, i) for i in range(120)}


def test_walks_leave_the_shard(spark):
    x = unit(np.random.default_rng(5).normal(size=(6, 8))).tolist()
    shards = spark.createDataFrame([(0, 1, x[1]), (0, 2, x[2]), (1, 2, x[2]), (1, 3, x[3])],
                                   "cluster int, node long, vec array<double>")
    got = {(r.cluster, r.node) for r in vg.visitors(shards, vg.build(shards)).collect()}
    assert got == {(1, 1), (0, 3)}


def test_audit_counts_each_linked_class_and_sees_a_lost_pair(spark):
    r = np.random.default_rng(6)
    group = unit(r.normal(size=16) + r.normal(size=(50, 16)) * 0.01)
    alone = unit(r.normal(size=(2, 16)))
    x = np.concatenate([group, alone, unit(alone + r.normal(size=(2, 16)) * 0.01)])
    classes = spark.createDataFrame([(i, v.tolist(), 100, i in (0, 50, 51)) for i, v in enumerate(x)],
                                    "node long, vec array<double>, times long, asked boolean")
    links = spark.createDataFrame([(0, 4900), (51, 100)], "node long, others long")     # 50 has lost its only link
    assert vg.audit(classes, links, 0.9) == pytest.approx(2 / 3)


def test_failed_audits_end_in_the_exact_comparison(spark, monkeypatch):
    monkeypatch.setattr(vg, "audit", lambda *a: 0.0)
    monkeypatch.setattr(vg, "MOST_OVERLAP", vg.OVERLAP)
    monkeypatch.setattr(vg, "visitors", lambda shards, graph: shards.limit(0))
    monkeypatch.setattr(vg, "shard_rows", lambda classes, overlap: classes.selectExpr("int(node) AS cluster", "node", "vec"))
    rows = list(enumerate(groups()))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert order(vg.links(docs).collect()) == order(brute(rows))
