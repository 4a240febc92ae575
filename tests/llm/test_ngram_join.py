import random

import pytest
from conftest import SF_MID, SF_SMALL

from freshstream.llm import ngram_join as nj
from freshstream.llm.common import table
from freshstream.llm.components import components


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate({i: " " for i in range(9, 14)}).split(" ") if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    """rows (doc_id, text): n_shingles and component per row, all pairs by an inverted index."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def noisy(seed=5):
    r = random.Random(seed)
    vocab = [f"V{i}" for i in range(400)]
    common = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(3)]
    out = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(1, 90))]
        for _ in range(r.choice([1, 1, 2, 3, 14])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w + [r.choice(common)] * r.randint(0, 1)))
    return out + [out[0].lower(), out[0], "", " \t\n", "one", "one two", "ONE", "x " * 3000, "x " * 2999]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_components_are_the_brute_force_ones(spark, monkeypatch, k, percent):
    monkeypatch.setattr(nj, "FOLLOWERS", 3)
    many = noisy()
    rows = [(3 * i % 997, t) for i, t in enumerate(many)] + [(None, many[0]), (None, "alone here"), (5000, None), (5000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(5)
    got = [tuple(r) for r in nj.join(docs, k, percent).collect()]
    assert order(got) == order(brute(rows, k, percent))


def test_chain_of_near_copies_and_a_common_passage(spark):
    """A chain of copies, each a few words from the last, far longer than a
    star reaches; documents that share a passage stay apart."""
    r = random.Random(9)
    w, rows = [f"a{i}" for i in range(120)], []
    for i in range(60):
        rows.append((1000 - i, " ".join(w)))
        w[2 * i] = f"z{i}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{r.randrange(10 ** 9)}" for _ in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert order(map(tuple, nj.join(docs, 4, 85).collect())) == order(brute(rows, 4, 85))


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert order(map(tuple, nj.join(docs, 4, 85).collect())) == order(brute(rows, 4, 85))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.join(docs).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(100, 100), (200, 199), (201, 199)],
                                  "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(71)}, 199: 199, 200: 199, 201: 199}


def test_place_filter_keeps_every_similar_pair():
    """Under any order, sets over the threshold meet early enough: no pair of
    random similar sets is lost by the prefixes of any order."""
    import numpy as np
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, nj.COUNTERS).astype("uint32")
    kept = dropped = 0
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype("uint64"))
        b = a[rng.random(len(a)) < rng.choice([0.5, 0.9, 1.0])]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype("uint64")]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        for order in range(nj.ORDERS):
            p, q = (nj.prefix(s, counts, order, 80) for s in (a, b))
            may = nj.may_meet(p.astype("uint32"), q.astype("uint32"), len(a), len(b), 80)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert may
                kept += 1
            else:
                dropped += not may
    assert kept > 50 and dropped > 50


def test_stars_unite_copies_of_one_text_at_once(spark, monkeypatch):
    """Copies that differ from each other by more than the threshold allows,
    but not from their original: one central star, nothing left to close."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(120):
        w = list(base)
        for _ in range(4):
            w[r.randrange(200)] = f"x{r.randrange(10 ** 9)}"
        rows.append((2 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = []
    kept = nj.closing_pairs
    monkeypatch.setattr(nj, "closing_pairs", lambda *a: made.append(n := kept(*a)) or n)
    got = [tuple(x) for x in nj.join(docs, 4, 85).collect()]
    assert order(got) == order(brute(rows, 4, 85))
    assert sum(m.count() for m in made) < 600


def test_sets_of_a_batch_are_those_of_each_text():
    """One pass over a batch of texts finds what splitting each text finds."""
    import numpy as np
    import pyarrow as pa
    texts = [*noisy(), "\tA b\x0bC d\x0c", "", " ", "x\x1cy\x85z \u00c9 \u00e9 a b", "w" * 64 + " " + "w" * 65, "W" * 65 + " " + "w" * 64,
             "w" * 200 + " a b c " + "w" * 201, "ab cd ef gh", "abcd ef gh", "a", "\u3000 a"]
    for words in (1, 2, 4, 5):
        number = {}
        for column in (pa.array(texts), pa.array(["head", *texts]).slice(1), pa.array(texts, pa.large_string())):
            tokens, ends = nj.shingled(column, words)
            assert len(ends) == len(texts) + 1 and ends[-1] == len(tokens)
            for t, lo, hi in zip(texts, ends[:-1], ends[1:]):
                own = shingles(t, words)
                assert hi - lo == len(own) and np.all(np.diff(tokens[lo:hi].astype("object")) > 0)
                number.setdefault(frozenset(own), tokens[lo:hi].tolist())
                assert number[frozenset(own)] == tokens[lo:hi].tolist()
        assert len({tuple(x) for x in number.values()}) == len(number)
    for few in (["", ""], ["a"], ["a b"], [" "]):
        for words in (1, 4, 5):
            assert np.diff(nj.shingled(pa.array(few), words)[1]).tolist() == [len(shingles(t, words)) for t in few]


def test_sketches_drop_no_similar_pair():
    import numpy as np
    rng = np.random.default_rng(8)
    kept = dropped = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype("uint64"))
        b = a[rng.random(len(a)) < rng.choice([0.3, 0.7, 0.95, 1.0])]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(1, 30))).astype("uint64")]))
        both, may = len(np.intersect1d(a, b)), nj.may_share(nj.sketch(a), nj.sketch(b), len(a), len(b), 85)
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert may
            kept += 1
        else:
            dropped += not may
    assert kept > 30 and dropped > 200


def test_a_pair_of_many_blocks_is_joined_once(spark):
    """Near copies share a run of prefix tokens: the block join makes a row for
    the first of them, not for each."""
    rows = [(token, node, 1000, token, node, 40) for node in range(40) for token in range(50)]
    at = spark.createDataFrame(rows, "token long, node long, n int, place int, component long, size long")
    met = nj.meetings(nj.with_earlier(at), 85)
    assert met.count() == met.distinct().count() == 40 * 39 // 2


def test_sets_are_moved_to_no_pair(spark):
    """Pairs meet prefixes and sketches, and find the sets to verify, without
    the table of sets being dealt again."""
    from freshstream.llm.common import bucketed, new_table, written
    some = lambda *r: spark.createDataFrame([(i, 3, b"", b"", b"") for i in range(*r)],
                                            "node long, n int, tokens binary, heads binary, sketch binary")
    to = new_table(spark, "test-sets")
    assert bucketed(some(4), to, "node").count() == 4
    sets = bucketed(some(4, 9), to, "node")                 # sets of a later round: the same table
    assert sets.count() == 9
    pairs = written(spark.createDataFrame([(1, 2), (3, 4)], "a long, b long"), "test-pairs").hint("shuffle_merge")
    plan = nj.beside(pairs, "b", sets, "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Union" not in plan and plan.count("Exchange hashpartitioning") == 1
