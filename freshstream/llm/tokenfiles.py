"""Flat token files: unsigned integers, 64-bit document offsets, memory maps.

Layout under one folder, one file of each kind per partition, written by
Spark's own (committing, retryable) text writer:

  kind=bin/part-NNNNN-*  token ids of the partition's documents, flat, each
                         document closed by ``end_id``
  kind=idx/part-NNNNN-*  uint64 little-endian: where each document ends,
                         in tokens from the start of this file
  kind=ids/part-NNNNN-*  pairs of uint64: doc_id (two's complement) and 1, or
                         0 and 0 for a NULL doc_id

File order (part numbers) is document order.  A file's base - the tokens of
all files before it - is the prefix sum of the file lengths.

The text writer closes every row with a separator byte.  Rows are cut so that
this byte is the 0 that ends a row anyway (a uint64 below 2**56, a flag, or
the last byte of ``end_id``), so the files hold nothing but the integers.  The
last byte of ``end_id`` in the chosen ``dtype`` therefore has to be 0: any id
below 256 in ``<u2``, below 2**24 in ``<u4``, multiples of 256 in ``>u2``.

Reading maps the files into memory where the folder is mounted (``file:`` or
no scheme: the shared folder of the cluster); in any other store the same
rows come from Spark's ``binaryFile`` source and views of its buffers.

Edge cases: NULL text is empty (only the end id); NULL, repeated and tied
doc_ids stay as rows (ties in text-hash order); an empty table writes no file
and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import path_exists
from .common import slices, texts, worker_cache

CACHE_WORDS = 400_000
#: Word pattern of byte-level BPE (fixed by the vocabulary), and what it comes to
#: in a text of Latin-1 characters only.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_LEVEL = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+"
               r"|\s+(?!\S)|\s+")


class WordCachedTokenizer:
    """The ``tokenizers`` library behind a cache of words: a byte-level BPE
    merges inside words only, so a text's ids are its words' ids in a row."""

    def __init__(self, path: str, dtype: str, specials_are_text: bool):
        import json
        import re

        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("byte-level BPE without a normalizer is needed")
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = specials_are_text
        self.lib.no_truncation()
        self.lib.no_padding()
        self.dtype, self.words, self.latin_words = dtype, regex.compile(BYTE_LEVEL), re.compile(LATIN_LEVEL)
        # words come cut and distinct: the library neither cuts nor caches them
        self.lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.lib.model._resize_cache(0)
        special = [] if specials_are_text else [t["content"] for t in spec["added_tokens"]]
        self.special, self.cut = set(special), None
        if special:
            self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.cache: dict[str, bytes] = {}

    def cut_words(self, text: str) -> list[str]:
        try:
            # re's \s also takes the four ASCII separators that Unicode's does not
            raw = text.encode("latin-1")
            if not any(c in raw for c in (28, 29, 30, 31)):
                return self.latin_words.findall(text)
        except UnicodeEncodeError:
            pass
        return self.words.findall(text)

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.cut_words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.cut_words(part)
        return out

    def encode(self, many: list[str]) -> list[bytes]:
        """Each text's ids as flat integers of ``dtype``."""
        from itertools import chain

        import numpy as np
        width = np.dtype(self.dtype).itemsize
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split, cache = list(map(self.split, many)), self.cache
        new = list(set(chain.from_iterable(split)).difference(cache))
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            e = self.lib.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat = np.asarray(e.ids, dtype=self.dtype).tobytes()
            cuts = (np.searchsorted(np.asarray(e.word_ids), np.arange(len(part) + 1)) * width).tolist()
            cache.update(zip(part, [flat[i:j] for i, j in zip(cuts, cuts[1:])]))
        return [b"".join(map(cache.__getitem__, words)) for words in split]


def in_document_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows range-partitioned and sorted by doc_id; equal ids are spread and
    ordered by their text's hash, so a repeated id cannot fill one partition."""
    d = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    return d.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")


def write(docs: DataFrame, out: str, path: str, end_id: int, dtype: str = "<u2",
          specials_are_text: bool = False) -> str:
    """Encode ``docs`` (doc_id, text; in the order of its partitions) with the
    byte-level BPE file ``path`` into token files under ``out``."""
    import numpy as np
    end = np.asarray([end_id], dtype=dtype).tobytes()
    if end[-1]:
        raise ValueError("the end id's last byte has to be 0 in this dtype")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = worker_cache(("word-cached", path, dtype, specials_are_text),
                           lambda: WordCachedTokenizer(path, dtype, specials_are_text))
        width, at, seq = np.dtype(dtype).itemsize, 0, 0
        for b in slices(batches, "text", 2 << 20):
            rows = [r + end for r in tok.encode(b.column(1).to_pylist())]
            ends = at + np.cumsum([len(r) // width for r in rows], dtype="int64")
            at, ids = int(ends[-1]), b.column(0)
            null = np.asarray(ids.is_null())
            pairs = np.empty((len(rows), 2), dtype="<i8")
            pairs[:, 0], pairs[:, 1] = np.asarray(ids.fill_null(0)), ~null
            value = [b"".join(rows), ends.astype("<u8").tobytes(), pairs.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["bin", "idx", "ids"]), pa.array([seq] * 3, pa.int64()),
                 pa.array([v[:-1] for v in value], pa.binary())], names=["kind", "seq", "value"])
            seq += 1

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind string, seq long, value binary")
    (rows.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
         .write.partitionBy("kind").option("lineSep", "\0").text(out))
    return out


def files(spark: SparkSession, out: str, dtype: str) -> DataFrame:
    """(path, part, n_tokens, base) of every token file: one row per file, the
    bases by prefix sums over the file sizes."""
    import numpy as np
    if not path_exists(spark, f"{out}/kind=bin"):
        return spark.createDataFrame([], "path string, part int, n_tokens long, base long")
    width = np.dtype(dtype).itemsize
    listed = (spark.read.format("binaryFile").load(f"{out}/kind=bin").select("path", "length")
              .withColumn("part", F.regexp_extract("path", r"/part-(\d+)", 1).cast("int"))
              .withColumn("n_tokens", (F.col("length") / width).cast("long")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.select("path", "part", "n_tokens",
                         F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))


def mounted(path: str) -> bool:
    return path.startswith(("file:", "/"))


def local(path: str) -> str:
    from urllib.parse import unquote
    return unquote(path[5:]) if path.startswith("file:") else path


def with_buffers(listed: DataFrame, out: str, kinds: tuple[str, ...]) -> DataFrame:
    """Add one column per kind: NULL where tasks can map the file themselves,
    the file's bytes (Spark's ``binaryFile`` source) in any other store."""
    if mounted(out):
        spread = listed.repartition(F.col("path"))
        return spread.select("*", *[F.lit(None).cast("binary").alias(k) for k in kinds])
    spark, df = listed.sparkSession, listed
    for k in kinds:
        own = spark.read.format("binaryFile").load(f"{out}/kind={k}").select(
            F.regexp_extract("path", r"/(part-[^/]+)$", 1).alias("_name"), F.col("content").alias(k))
        df = df.withColumn("_name", F.regexp_extract("path", r"/(part-[^/]+)$", 1)).join(own, "_name").drop("_name")
    return df


def view(path: str, content: bytes | None, kind: str, dtype: str):
    """A token or side file as an integer array: memory-mapped, or a view."""
    import numpy as np
    if content is not None:
        return np.frombuffer(content, dtype=dtype)
    return np.memmap(local(path.replace("/kind=bin/", f"/kind={kind}/")), dtype=dtype, mode="r")


def read(spark: SparkSession, out: str, dtype: str = "<u2") -> DataFrame:
    """Per document, from the files alone: doc_id, start (tokens of all
    documents before it), n_tokens (with the end id) and tokens (binary: its
    ids as little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for b in batches:
            for f in b.to_pylist():
                ids = view(f["path"], f["ids"], "ids", "<i8").reshape(-1, 2)
                ends = view(f["path"], f["idx"], "idx", "<u8").astype("int64")
                tokens, lo = view(f["path"], f["bin"], "bin", dtype), 0
                starts = np.concatenate([[0], ends[:-1]]).astype("int64")
                while lo < len(ends):
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), side="right")))
                    wide = np.asarray(tokens[starts[lo]:ends[hi - 1]]).astype("<u4")
                    cuts = (np.concatenate([starts[lo:hi], ends[hi - 1:hi]]) - starts[lo]) * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi, 0], pa.int64(), mask=ids[lo:hi, 1] == 0),
                         pa.array(f["base"] + starts[lo:hi]), pa.array(ends[lo:hi] - starts[lo:hi]),
                         pa.Array.from_buffers(pa.binary(), hi - lo,
                                               [None, pa.py_buffer(cuts.astype("int32")), pa.py_buffer(wide)])],
                        names=["doc_id", "start", "n_tokens", "tokens"])
                    lo = hi

    listed = with_buffers(files(spark, out, dtype), out, ("bin", "idx", "ids"))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, tokens binary")
