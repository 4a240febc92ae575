"""Token counts from flat, unindexed token files: a vectorised separator scan.

The stream is all token files in part order.  It is read in fixed blocks of
tokens; in each block numpy finds the end-of-document ids at once.  A block
yields one row per document that ends in it, plus its summary: how many ends
it has and where the last one is.  A prefix scan over the summaries - per file
first, then over one row per file - carries into each block the number of
documents before it and the position where its first document began, however
many blocks or files back that is.  The documents' rows are never gathered:
the scan handles one row per block, partitioned by file.

Tokens behind the last separator of the stream form an unclosed document: it
is counted with ``closed`` false and no separator.  Empty files and an empty
folder give no rows; adjacent separators give documents of one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokenfiles import files, mounted, view, with_buffers

BLOCK_TOKENS = 1 << 21


def block_scan(spark: SparkSession, out: str, end_id: int, dtype: str, block: int) -> DataFrame:
    """(part, block, first, size, ends array<long>): each block's place in its
    file and the file positions of its separators."""
    import numpy as np
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for b in batches:
            for f in b.to_pylist():
                tokens = view(f["path"], f["bin"], "bin", dtype)
                for k in ([f["block"]] if f["block"] is not None else range(-(-len(tokens) // block))):
                    own = tokens[k * block:(k + 1) * block]
                    ends = np.flatnonzero(np.asarray(own) == end_id).astype("int64") + k * block
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f["part"]], pa.int32()), pa.array([k], pa.int64()),
                         pa.array([len(own)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                        names=["part", "block", "size", "ends"])

    listed = files(spark, out, dtype).where("n_tokens > 0")
    last = F.floor((F.col("n_tokens") - 1) / block).cast("long")
    if mounted(out):                      # any task can map any block
        blocks = listed.select("path", "part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        blocks = blocks.repartition(F.col("part"), F.col("block")).withColumn("bin", F.lit(None).cast("binary"))
    else:                                 # a file's buffer is cut by its task
        blocks = with_buffers(listed.select("path", "part"), out, ("bin",)).withColumn(
            "block", F.lit(None).cast("long"))
    return blocks.mapInArrow(run, "part int, block long, size long, ends array<long>")


def count(spark: SparkSession, out: str, end_id: int, dtype: str = "<u2",
          block: int = BLOCK_TOKENS) -> DataFrame:
    """(part, doc_in_part, doc_no, start, n_tokens, closed): one row per
    document of the stream; a document belongs to the file it ends in."""
    found = written(block_scan(spark, out, end_id, dtype, block), "separator-blocks")
    base = files(spark, out, dtype).select("part", "base")
    summary = found.select("part", "block", F.size("ends").cast("long").alias("n"),
                           F.try_element_at("ends", F.lit(-1)).alias("last")).join(base, "part")
    summary = summary.withColumn("last", F.col("last") + F.col("base"))
    # over files: one row each
    per_file = summary.groupBy("part", "base").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("part", "base",
                               F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("docs_before"),
                               F.max("last").over(earlier).alias("last_before"))
    # inside a file: one row per block
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (summary.drop("base").join(per_file, "part")
             .select("part", "block", "base", "docs_before",
                     F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("docs_in_part"),
                     F.greatest(F.max("last").over(inside), F.col("last_before")).alias("last_before")))
    # each end with the end before it, in file positions
    previous = F.concat(F.array(F.coalesce(F.col("last_before"), F.lit(-1)) - F.col("base")),
                        F.slice("ends", 1, F.size("ends") - 1))
    docs = (found.where(F.size("ends") > 0).join(carry, ["part", "block"])
            .select("part", "base", "docs_before", "docs_in_part",
                    F.posexplode(F.arrays_zip(previous.alias("previous"), F.col("ends").alias("end"))).alias("i", "x")))
    begin = F.col("x.previous") + F.col("base") + 1
    docs = docs.select("part", (F.col("docs_in_part") + F.col("i")).alias("doc_in_part"),
                       (F.col("docs_before") + F.col("docs_in_part") + F.col("i")).alias("doc_no"),
                       begin.alias("start"), (F.col("x.end") - F.col("x.previous")).alias("n_tokens"),
                       F.lit(True).alias("closed"))
    # what stands behind the last separator
    total = files(spark, out, dtype).agg(F.sum("n_tokens").alias("total"), F.max("part").alias("part"))
    tail = summary.agg(F.sum("n").alias("doc_no"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    rest = (total.join(tail).where("total > last + 1")
            .select("part", F.lit(None).cast("long").alias("doc_in_part"), "doc_no",
                    (F.col("last") + 1).alias("start"), (F.col("total") - F.col("last") - 1).alias("n_tokens"),
                    F.lit(False).alias("closed")))
    return docs.unionByName(rest)


def document_ids(spark: SparkSession, out: str) -> DataFrame:
    """(part, doc_in_part, doc_id) from the files' own side files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for b in batches:
            for f in b.to_pylist():
                ids = view(f["path"], f["ids"], "ids", "<i8").reshape(-1, 2)
                for lo in range(0, len(ids), 1 << 18):
                    own = ids[lo:lo + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), f["part"], "int32")),
                         pa.array(np.arange(lo, lo + len(own), dtype="int64")),
                         pa.array(own[:, 0], pa.int64(), mask=own[:, 1] == 0)],
                        names=["part", "doc_in_part", "doc_id"])

    listed = with_buffers(files(spark, out, "<u2").select("path", "part"), out, ("ids",))
    return listed.mapInArrow(run, "part int, doc_in_part long, doc_id long")
