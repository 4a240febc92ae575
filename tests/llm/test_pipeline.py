import os
import re
import subprocess
import sys
from collections import Counter

import public_tokenizers
import pytest
from conftest import ROOT, SF_SMALL
from tokenizers import Tokenizer

import corpus_pipeline as cp
from freshstream.llm.common import table, written

sys.path.insert(0, os.path.dirname(__file__))
from test_ngram_join import brute as groups  # noqa: E402
from test_pii import PATTERNS, passed  # noqa: E402


def redacted(text):
    spans = sorted((m.start(), -m.end(), k) for k, p in PATTERNS for m in re.finditer(p, text) if passed(k, m.group()))
    out, at = "", 0
    while spans:
        s, e, k = spans.pop(0)
        e = -e
        while spans and spans[0][0] < e:
            e = max(e, -spans.pop(0)[1])
        out, at = out + text[at:s] + f"[{k.upper()}]", e
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_SMALL, "documents"), []
    out.append(docs.collect())
    for name, f in cp.STAGES:
        docs = written(f(spark, docs, SF_SMALL), name)
        out.append((docs.columns, docs.collect()))
    return out


def test_columns_and_sizes(stages):
    first = stages[0]
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "pii", "mix", "bpe"]
    for cols, _ in stages[1:-1]:
        assert cols == list(first[0].__fields__)


def test_quality_drops_labelled_junk_only(spark, stages):
    good = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    kept = {r.doc_id for r in stages[1][1]}
    junk = [r.doc_id for r in stages[0] if good.get(r.doc_id) == 0]
    clean = [r.doc_id for r in stages[0] if good.get(r.doc_id) == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in junk) <= 0.5 * len(junk)


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1][1]]
    want = sorted({d for d, n, c in groups(rows, 5, 80) if d == c})
    assert sorted(r.doc_id for r in stages[2][1]) == want
    assert {tuple(r) for r in stages[2][1]} <= {tuple(r) for r in stages[1][1]}


def test_pii(stages):
    before = {r.doc_id: r.text for r in stages[2][1]}
    after = {r.doc_id: r for r in stages[3][1]}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert after[i].text == redacted(t) and after[i].n_chars == len(after[i].text)


def test_mix_and_bpe(stages):
    kept = {r.doc_id: tuple(r) for r in stages[3][1]}
    mixed = Counter(r.doc_id for r in stages[4][1])
    assert all(tuple(r) == kept[r.doc_id] for r in stages[4][1]) and max(mixed.values()) <= 5
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in stages[4][1]}
    assert Counter(r.doc_id for r in stages[5][1]) == mixed
    for r in stages[5][1]:
        assert r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark, stages):
    got = Counter((r.doc_id, tuple(r.ids)) for r in cp.run(spark, SF_SMALL).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[5][1])


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5),
         (2, "", "en", None, 0), (3, "mail a@b.cd " * 30, "en", "s", 360), (3, "mail a@b.cd " * 30, "en", "s", 360),
         (4, "mail a@b.cd " * 30, None, "s", 360)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in cp.STAGES:
        for d in (docs, docs.limit(0)):
            f(spark, d, SF_SMALL).collect()
    kept = cp.near_duplicate_stage(spark, docs, SF_SMALL).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, -1, 1, 2, 3]


def test_the_rest_works_without_this_subpackage(tmp_path):
    script = "import __spark_entry__ as e; q = e.queries(); assert 'q1_all' in q and not any(k.startswith('op') for k in q)"
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "freshstream", "tests"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "freshstream")
    for name in os.listdir(os.path.join(ROOT, "freshstream")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "freshstream", name), tmp_path / "freshstream" / name)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    r = subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path, capture_output=True, text=True,
                       env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]


CLASHING = ["_score", "_stay", "_first", "_pass", "_passes", "_last", "_taken", "_order", "_weight", "score", "stay",
            "first", "c0", "c1", "row", "cands", "component_id", "n_shingles", "node", "token", "a.b"]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "pii", "mix"])
def test_extra_columns_with_the_stages_own_names_stay(spark, name):
    from pyspark.sql import functions as F
    docs = table(spark, SF_SMALL, "documents").limit(60)
    more = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in CLASHING])
    got = dict(cp.STAGES)[name](spark, more, SF_SMALL)
    assert got.columns == more.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHING)


def test_mix_keeps_columns_that_look_like_its_own(spark):
    from freshstream.llm import mixing
    docs = spark.createDataFrame([(i, "a b c", "s%d" % (i % 2), i, "x", "y") for i in range(20)],
                                 "doc_id long, text string, source string, _pass long, _passes string, _last string")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "_passes", "_last", "_pass", "_order", "_weight"]
    assert {(r._passes, r._last) for r in out.collect()} == {("x", "y")}
