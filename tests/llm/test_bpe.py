import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from freshstream.llm.bpe import RankArrayBpe, encode, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello World", "don't 'stop'  it's", "a" * 5000, "x1y22 ²½ ⅷ", "ΟΔΟΣ ΣΑΣ", "İstanbul",
         "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|EndOfText|>", "été naïve", "日本語テキスト",
         "emoji 👩‍👩‍👧 ok", "tab\t\nnl\x0b\x0c\x85\xa0 z", "a_b__c-d", "​﻿", "''s's't", "?!..,;", "\x00\x01"]


def noise(n, seed=7):
    r = random.Random(seed)
    pools = ["abc THE the ing'tion ", "éèüßñÑçÖ ", "0123 .,;:-'\"!", "ΑΣς", "日本한글", "👍́‍"]
    return ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 400))) for _ in range(n)]


def test_matches_the_library():
    lib, own = Tokenizer.from_file(PATH), RankArrayBpe(PATH)
    for t in TEXTS + noise(300):
        want = lib.encode(t, add_special_tokens=False).ids
        got = [i for w in own.encode(t) for i in w]
        assert got == want, t
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False), t


def test_scan_and_heap_agree():
    own, r = RankArrayBpe(PATH), random.Random(3)
    for _ in range(300):
        ids = [own.first[r.choice(b"abethinr")] for _ in range(r.randint(1, 90))]
        assert own.merge_scan(list(ids)) == own.merge_heap(list(ids))


def test_rows_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [Row(doc_id=i, text=t, ids="x", decoded=None) for i, t in enumerate(TEXTS)]
        + [Row(doc_id=None, text="a b", ids="x", decoded=None), Row(doc_id=1, text=None, ids=None, decoded=None),
           Row(doc_id=1, text=None, ids=None, decoded=None)],
        "doc_id long, text string, ids string, decoded string")
    lib = Tokenizer.from_file(PATH)
    rows = encode_decode(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 3
    want = sorted([(i, lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)]
                  + [(-1, lib.encode("a b", add_special_tokens=False).ids), (1, []), (1, [])])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in rows) == want
    assert all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert encode(docs.limit(0), PATH).count() == 0


def test_lists_are_decoded_by_columns():
    own = RankArrayBpe(PATH)
    ids = [[i for w in own.encode(t) for i in w] for t in TEXTS] + [None, []]
    column = pa.array(ids, pa.list_(pa.int32()))
    want = [own.decode(x or ()) for x in ids]
    assert own.decode_lists(column).to_pylist() == want
    assert own.decode_lists(column.slice(3, 5)).to_pylist() == want[3:8]
    assert own.decode_lists(column.slice(0, 0)).to_pylist() == []
    for wrong in ([max(own.tokens) + 1], [None]):
        with pytest.raises((KeyError, IndexError)):
            own.decode_lists(pa.array([wrong], pa.list_(pa.int32())))
