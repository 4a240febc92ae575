import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from freshstream.llm import separators, tokenfiles
from freshstream.llm.common import texts
from freshstream.session import fresh_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello, world! it's", "  two  spaces \n\n x", "<|endoftext|> in text", "été 日本 👍", "!" * 300, "x" * 9000,
         " ", "\t", "1234 ²½", "a<|endoftext|>"]


def documents(spark, n=60):
    r = random.Random(5)
    rows = [Row(doc_id=i, text=r.choice(TEXTS) + " tail" * r.randint(0, 9), start="x") for i in range(n)]
    rows += [Row(doc_id=3, text=None, start=None), Row(doc_id=None, text="null id", start=None), rows[7], rows[7]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)


@pytest.mark.parametrize("store", ["mapped", "buffers"])
def test_files_round_trip(spark, store, monkeypatch):
    if store == "buffers":
        monkeypatch.setattr(tokenfiles, "mounted", lambda path: False)
    rows, docs = documents(spark)
    out = tokenfiles.write(tokenfiles.in_document_order(docs), fresh_dir(spark, "t"), PATH, end_id=0)
    got = sorted(tokenfiles.read(spark, out).collect(), key=lambda r: r.start)
    lib, at = Tokenizer.from_file(PATH), 0
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(np.asarray(
        lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.tokens)) for r in got) == want
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens) // 4
        at += r.n_tokens


def test_empty_table(spark):
    _, docs = documents(spark)
    out = tokenfiles.write(texts(docs.limit(0)), fresh_dir(spark, "t"), PATH, end_id=0)
    assert tokenfiles.read(spark, out).count() == 0
    assert separators.count(spark, out, 0).count() == 0


def test_end_id_needs_a_zero_byte(spark):
    with pytest.raises(ValueError):
        tokenfiles.write(documents(spark)[1], "unused", PATH, end_id=50256)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("store", ["mapped", "buffers"])
def test_separator_scan(spark, block, store, monkeypatch):
    rows, docs = documents(spark, 12)
    out = tokenfiles.write(texts(docs), fresh_dir(spark, "t"), PATH, 0xFF00, ">u2", True)
    if store == "buffers":
        monkeypatch.setattr(tokenfiles, "mounted", lambda path: False)
        monkeypatch.setattr(separators, "mounted", lambda path: False)
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    counts = separators.count(spark, out, 0xFF00, ">u2", block=block)
    got = counts.join(separators.document_ids(spark, out), ["part", "doc_in_part"]).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(lib.encode(r.text or "").ids) + 1) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want
    assert sorted(r.doc_no for r in got) == list(range(len(rows))) and all(r.closed for r in got)
    # another separator: documents span files, the last one stays open
    stream = np.concatenate([np.fromfile(tokenfiles.local(f.path), ">u2") for f in
                             sorted(tokenfiles.files(spark, out, ">u2").collect(), key=lambda f: f.part)])
    sep = int(stream[len(stream) // 2])
    ends = np.flatnonzero(stream == sep)
    begins = np.concatenate([[0], ends + 1])
    want = [(int(a), int(b - a + 1), True) for a, b in zip(begins, ends)]
    if begins[-1] < len(stream):
        want.append((int(begins[-1]), int(len(stream) - begins[-1]), False))
    got = separators.count(spark, out, sep, ">u2", block=block).collect()
    assert sorted((r.start, r.n_tokens, r.closed) for r in got) == want


def test_words_are_cut_as_the_vocabulary_says():
    """Latin-1 texts take a plain pattern; every character, alone and between
    others, falls as the general pattern has it."""
    import public_tokenizers
    import regex

    from freshstream.llm.tokenfiles import BYTE_LEVEL, WordCachedTokenizer
    tok = WordCachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), "<u2", True)
    general = regex.compile(BYTE_LEVEL)
    for i in range(0x250):
        c = chr(i)
        for text in (c, f" {c}", f"{c}a", f"a{c}1", f" {c}{c}", f"{c} ", f"\n{c}", f"1{c}", f"a{c}\x1cb", f"don't{c}x"):
            assert tok.cut_words(text) == general.findall(text), (hex(i), text)
