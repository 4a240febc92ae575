"""BPE encoding and decoding by contiguous rank arrays.

A tokenizer file (its path is a parameter; the file is never trained or
copied) is read into plain tables.  A text is cut at special tokens,
normalised, split into words, and every word is merged like this: its parts'
ids and the ranks of adjacent pairs sit in two short contiguous lists; the
smallest rank is searched by a scan, the boundary behind it is deleted, and
the ranks of the two neighbours are refreshed.  Words longer than
``SHORT_WORD`` parts use the same merge order with a heap of ranks instead of
the scan, so that one enormous word costs n log n, not n squared.

Spark partitions the documents; there is no shuffle, and each Python task
streams Arrow slices of a few MB and keeps a bounded cache of merged words.

Edge cases: NULL text counts as empty; an empty text gives no ids and the
empty decoded text; NULL and repeated ids are passed through row by row;
empty tables give empty results; other input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, texts, worker_cache

SHORT_WORD = 96
CACHE_WORDS = 200_000
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others are numbered from
    U+0100 in ascending order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own, table, spare = set(printable), [], 0x100
    for b in range(256):
        if b in own:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


class RankArrayBpe:
    """One tokenizer file as tables: vocabulary, pair ranks, special tokens."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.tokens |= {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.first = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + self.suffix) for c in alphabet]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = {s["type"] for s in steps}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}
        self.column: pa.Array | None = None

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (no final-sigma rule)."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text

    def merge(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        return self.merge_scan(ids) if len(ids) <= SHORT_WORD else self.merge_heap(ids)

    def rank(self, a: int, b: int) -> int:
        found = self.pairs.get((a, b))
        return found[0] if found else NO_RANK

    def merge_scan(self, ids: list[int]) -> list[int]:
        ranks = [self.rank(a, b) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            ids[at] = self.pairs[ids[at], ids[at + 1]][1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = self.rank(ids[at - 1], ids[at])
            if at < len(ranks):
                ranks[at] = self.rank(ids[at], ids[at + 1])
        return ids

    def merge_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := self.rank(ids[i], ids[i + 1])) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue                      # an older state of this boundary
            ids[i] = self.pairs[a, b][1]
            alive[j] = False
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := self.rank(ids[x], ids[y])) != NO_RANK:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive) if ok]

    def words(self, text: str) -> list[str]:
        """Words in order; special tokens stand among them as themselves."""
        if self.cut is None or "<|" not in text:
            return self.word.findall(self.normalise(text))
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.word.findall(self.normalise(part))
        return out

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each word, special tokens included."""
        words, cache = self.words(text), self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            if w in self.special:
                cache[w] = (self.special[w],)
            else:
                cache[w] = tuple(self.merge(w))
        return list(map(cache.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """``decode`` of every list (NULL: empty), column by column."""
        if self.column is None:
            self.column = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())
        tokens = self.column.take(ids.flatten())
        if tokens.null_count:
            raise KeyError("an id that the tokenizer file does not have")
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(ids), 0))
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def tokenizer(path: str) -> RankArrayBpe:
    return worker_cache(("rank-array-bpe", path), lambda: RankArrayBpe(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        bpe = tokenizer(path)
        for b in slices(batches, "text", 2 << 20):
            flat, ends = [], [0]
            for text in b.column(1).to_pylist():
                flat.append(np.fromiter(chain.from_iterable(bpe.encode(text)), dtype="int32"))
                ends.append(ends[-1] + len(flat[-1]))
            values = np.concatenate(flat) if flat else np.empty(0, "int32")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for rows of (doc_id, ids); NULL ids decode to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bpe.decode_lists(b.column(1))],
                                                 names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))``: (doc_id, ids, decoded)."""
    return decode(encode(docs, path, id_col, text_col), path)
