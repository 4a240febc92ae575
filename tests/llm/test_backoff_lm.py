import math
import random
import zlib
from collections import Counter

import pytest

from freshstream.llm import backoff_lm as lm


def corpus(n=90):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(vocab[min(39, int(r.expovariate(0.15)))] for _ in range(r.randint(0, 60))) for _ in range(n)]
    rows = [(i, t.upper() if i % 7 == 0 else t, 0) for i, t in enumerate(texts)]
    return rows + [(3, None, 1), (None, "w1 w2 w99", 2), (5, "w1  w2\tÉÉ unseen", 3), (5, "w1  w2\tÉÉ unseen", 3),
                   (200, "w0 " * 5000, 4)]


def brute(rows, order, word_share, arc_share):
    tok = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
                     for w in (t or "").translate({i: " " for i in range(9, 14)}).split(" ") if w] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [tok(t) for i, t, _ in rows if i is not None and not held(i)]
    c1 = Counter(w for t in train for w in t)
    n, v = sum(c1.values()), len(c1)
    uni = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    kept = {(w,): c for w, c in c1.items() if c >= word_share * n and (c >= arc_share * n or w is None)}
    levels = [kept]
    for k in range(2, order + 1):
        c = Counter(tuple(([None] + t)[i:i + k]) for t in train for i in range(len(t) + 2 - k))
        levels.append({g: x for g, x in c.items() if g[:-1] in levels[-1] and g[1:] in levels[-1]
                       and x >= arc_share * n})

    def p(h, w):
        if not h:
            return uni(w)
        out = {g: x for g, x in levels[len(h)].items() if g[:-1] == h} if len(h) < order else {}
        if not out:
            return p(h[1:], w)
        total = levels[len(h) - 1][h]
        left = 1 - sum(x - 0.5 for x in out.values()) / total
        return max(out.get((*h, w), 0) - 0.5, 0) / total + left * p(h[1:], w)

    memo = {}
    out = []
    for i, t, _ in rows:
        ws, total, base, h = tok(t), 0.0, 0.0, (None,)
        for w in ws:
            key = (h, w)
            if key not in memo:
                memo[key] = math.log10(p(h, w))
            total += memo[key]
            base += math.log10(uni(w))
            h = (*h, w)[-(order - 1):]
        out.append((i, held(i), len(ws), sum(w in c1 for w in ws), n, base, total))
    return out


@pytest.mark.parametrize("order,word_share,arc_share", [(3, 1e-9, 1e-9), (3, 0.004, 0.01), (2, 0.01, 0.02), (2, 0.5, 0.9)])
def test_scores_are_the_brute_force_ones(spark, order, word_share, arc_share):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = lm.score(docs, order=order, word_share=word_share, arc_share=arc_share).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    want = sorted(brute(rows, order, word_share, arc_share), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6), g[0]


def local_counts(levels, order):
    """What owners answer, from one block that holds the whole corpus."""
    import numpy as np
    out = []
    for g in levels:
        total = np.bincount(g.history, weights=g.n, minlength=g.size).astype("int64")
        types = np.bincount(g.history, weights=g.n > 0, minlength=g.size).astype("int64")
        out.append({"n": g.n, "total": total, "kept": total, "types": types})
    return out


def one_block(texts, train, order):
    import numpy as np
    numbers = lm.Numbers()
    parts = [[lm.END, *lm.words_of(t), lm.END] for t in texts]
    ids = np.array([numbers[w] for x in parts for w in x])
    words = numbers.keys_of()
    row = {"words": words.tobytes(), "ids": lm.pack(ids), "size": [len(x) - 1 for x in parts], "train": train}
    block = lm.Block(row)
    n = np.bincount(block.ids, weights=block.train & ~block.first).astype("int64")
    _, turn, runs = lm.lists(block.words, 3)
    block.numbered([{"bucket": i, "n": lm.pack(n[turn[lo:hi]]), "total": lm.pack(turn[lo:hi])}
                    for i, (lo, hi) in enumerate(runs)], 3)
    return block, list(block.grams(order, [np.zeros(0, "uint64")] * (order - 1), 3))


def test_states_are_distributions():
    import numpy as np
    texts = [t for _, t, _ in corpus(60)[:60]]
    block, levels = one_block(texts, [True] * 60, 3)
    counts = local_counts(levels, 3)
    n = int(block.n.sum())
    automaton, here, *_ = lm.laid_out(block, levels, counts, n, 1)
    assert len(automaton.fail) > 200 and (automaton.fail < np.maximum(1, np.arange(len(automaton.fail)))).all()
    words = np.flatnonzero(np.bincount(block.ids, minlength=len(block.words)))
    want = (n + lm.ADD * len(words)) / n                     # the unigram's own sum under this scale
    sums = []
    for s in range(len(automaton.fail)):
        log, _ = automaton.step(np.full(len(words), s), words)
        sums.append((10 ** log).sum())
    left = 10 ** automaton.weight
    assert sums[0] == pytest.approx(want)
    for s in range(1, len(sums)):                             # arcs take 1 - weight, the rest is the shorter state's
        assert sums[s] == pytest.approx(1 + left[s] * (sums[automaton.fail[s]] - 1), rel=1e-9)


def test_walks_in_pieces_equal_whole_walks(monkeypatch):
    import numpy as np
    texts = [t or "" for _, t, _ in corpus(40)]
    train = [i % 3 > 0 for i in range(len(texts))]
    block, levels = one_block(texts, train, 3)
    counts = local_counts(levels, 3)
    scale = block.n.sum() + 5.0
    whole = lm.walked(block, levels, counts, scale, 1)
    monkeypatch.setattr(lm, "PIECE", 7)
    for a, b in zip(whole, lm.walked(block, levels, counts, scale, 1)):
        assert np.allclose(a, b, rtol=1e-12)


def test_histories_stand_before_every_n_gram():
    import numpy as np
    block, levels = one_block(["a b a", "", "b a b a c", "c"], [True] * 4, 4)
    for k, g in enumerate(levels, 2):
        got = block.histories(k, np.ones(len(block.words), dtype=bool))
        assert len(got) == (g.of >= 0).sum() and len(np.unique(got)) == g.size
        some = block.histories(k, np.arange(len(block.words)) < 2)
        assert set(some.tolist()) <= set(got.tolist())


def test_packed_numbers_come_back():
    import numpy as np
    for values in ([], [0], [255, 0], [65535, 1], [2 ** 32 - 1], [2 ** 64 - 1, 0, 7]):
        assert lm.unpack(lm.pack(np.array(values, dtype="uint64"))).tolist() == values


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm.score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [5e-6, 0.02, 0.0])
def test_n_grams_seen_once_count_whatever_the_corpus_size(spark, share):
    rows = [*corpus(), *[(1000 + i, "filler " * 500, 5) for i in range(1000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    # many buckets, with histories dealt out to all of them, in the other two
    given = {} if share == 5e-6 else {"word_share": share, "held_share": share, "bucket": 400 if share else 4000}
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got = sorted(map(tuple, lm.score(docs, **given).collect()), key=key)
    want = sorted(brute(rows, 3, 1e-12, 1e-12), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-6), g[0]


def test_words_cut_by_the_batch_are_those_of_each_text():
    import numpy as np
    import pyarrow as pa
    texts = ["", "a\x1cb\x1d C\x1f\x85x\xa0y Z", None, "  \t\n", "\x0bA\x0cB\r\n CÉİ \x00 d\x00e ", "a a", " b"]
    numbers, parts = lm.Numbers(), [[lm.END, *lm.words_of(t or ""), lm.END] for t in texts]
    ids = [numbers[w] for x in parts for w in x]
    for t in (pa.array(texts), pa.array(["q r", *texts, "s"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        key, got = lm.tokens_of(*(found := lm.cut(t)))
        assert found[1].tolist() == [len(x) - 2 for x in parts]
        assert got.tolist() == ids and key.tolist() == numbers.keys_of().tolist()
    key, got = lm.tokens_of(*lm.cut(pa.array(["", None], pa.string())))
    assert got.tolist() == [0] * 4 and len(key) == 1


def test_keys_grouped_by_one_sort_are_the_unique_ones():
    import numpy as np
    r = np.random.default_rng(3)
    wide = r.integers(0, 1 << 64, 50, dtype="uint64")
    low = np.uint64(7) << np.uint64(61) | r.integers(0, 4, 1000).astype("uint64")     # differ in the low bits only
    for key in (r.integers(0, 99, 1000), wide[r.integers(0, 50, 1000)], low, np.zeros(0, "int64"), wide[:1],
                np.array([(1 << 64) - 1, 0, 5, (1 << 64) - 1], dtype="uint64"), np.array([1 << 53, 1, 1 << 53])):
        one, first, of = lm.grouped(key)
        want = np.unique(key, return_index=True, return_inverse=True)
        assert one.tolist() == want[0].tolist() and first.tolist() == want[1].tolist() and of.tolist() == want[2].tolist()
        found, turn = lm.in_order(key)
        assert found.tolist() == sorted(key.tolist()) and turn.tolist() == np.argsort(key, kind="stable").tolist()
    few = np.sort(wide[:20])
    assert lm.among(wide, few).tolist() == [True] * 20 + [False] * 30
    assert not lm.among(wide, few[:0]).any()


def test_n_grams_of_a_block_need_no_indirect_sorts(monkeypatch):
    """The tokens of a block are sorted once for each order, by a plain sort;
    only buckets (16 bits, a radix sort) are sorted by their places."""
    import numpy as np
    texts = [t or "" for _, t, _ in corpus()]
    block, _ = one_block(texts, [True] * len(texts), 3)
    assert len(block.ids) > 5000
    seen = []
    for name in ("unique", "argsort", "lexsort"):
        def spy(a, *args, name=name, real=getattr(np, name), **kw):
            if name != "argsort" or np.asarray(a).dtype.itemsize > 2:
                seen.append(np.asarray(a).shape[-1])
            return real(a, *args, **kw)
        monkeypatch.setattr(np, name, spy)
    levels = list(block.grams(3, [np.zeros(0, "uint64")] * 2, 3))
    assert max(seen, default=0) < 100 and sum(g.n.sum() for g in levels) > 5000
