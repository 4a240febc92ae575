"""Fill-in-the-middle against a plain-Python model of the contract."""

import hashlib

import pytest

from conftest import SF_MID
from freshstream.llm import fill_in_middle as M
from freshstream.llm.queries import QUERIES


def model(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text))


def check(spark, folder, rows):
    got = [tuple(r) for r in QUERIES["op11_repeated_capture"](spark, folder).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted((model(*r) for r in rows), key=key)


def test_query_equals_model_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(spark, SF_MID, rows)


def test_edges(spark, workdir):
    """NULLs, empty, markers and half markers, astral and combining characters,
    line ends, repeated ids, a text of several pieces, clashing columns."""
    texts = [None, "", "a", "<P>", "x<M>y", "<P", "<S<S>", ">", "é\U0001F600\r\n\x00z", "\n", "<<>>" * 5,
             "abé" * (M.PIECE // 2)]
    rows = [(i, t) for i, t in enumerate(texts * 4)] + [(None, "no id"), (7, "again"), (7, "again")]
    spark.createDataFrame([(*r, 1, "h", "o") for r in rows],
                          "doc_id bigint, text string, n int, h0 string, output string") \
        .write.parquet(f"{workdir}/documents.parquet")
    check(spark, workdir, rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.transform(empty).count() == 0


def test_all_ends_of_one_match():
    assert M.unit_ends("abc") == [[1, 2, 3]] and M.unit_ends("") == []
    assert M.unit_ends("abcdefg", piece=3) == [[1, 2, 3], [4, 5, 6], [7]]
    found = M.unit_ends("abcdefg", piece=3)
    assert [M.end_of(found, k) for k in range(8)] == list(range(8))


@pytest.mark.parametrize("unit", [r"\X", r"\S+\s*|\s+"])
def test_other_units_cut_between_units(spark, unit):
    import regex
    text = "éa  bb\tć d. " * 9
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(99, "")], "doc_id bigint, text string")
    ends = {0, *[m.end() for m in regex.finditer(unit, text)]}
    out = M.transform(df, unit=unit)
    rows = out.select("*", M.restore(out.form, out.output).alias("back")).collect()
    for r in rows:
        if r.doc_id == 99:
            assert (r.n, r.form, r.output) == (0, "plain", "")
            continue
        assert r.back == text and r.n == len(ends) - 1
        assert r.form == "plain" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends
    assert len({r.form for r in rows}) == 3


def test_uncovered_text_stays_plain(spark):
    df = spark.createDataFrame([(i, "ab1") for i in range(20)], "doc_id bigint, text string")
    assert {r.form for r in M.transform(df, unit="[a-z]").collect()} == {"plain"}
