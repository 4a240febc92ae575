"""Document fingerprints: quartile bucket digests.

Every window of three UTF-8 bytes is hashed into one of 128 buckets.  The
quartiles of a text's 128 counts cut each bucket into a 2-bit code (how many
quartiles its count exceeds); the digest is the hex of those codes, one byte
for the length on a logarithmic scale, and one for the quartile ratios.
Equal texts have equal digests, and so have all texts of under three bytes
and of equal length (no windows: all codes are 0).

Two digests differ by the sum of their code differences (opposite codes, 0
against 3, count 6), of the length and of the ratio differences, bounded by
``BOUND``; their likeness is ``1 - difference / BOUND``.

Documents are compared with their successor in ascending doc_id.  They are
range-partitioned and sorted once (equal ids by text hash, so a repeated id
spreads out; NULL ids first); a task streams its rows and pairs neighbours.
Only a partition's first and last documents meet others' rows, in a second
small step over two rows per partition.

Edge cases: NULL text is empty; a table of one row is its own successor;
repeated rows are rows; an empty table gives no rows; long texts are hashed
in chunks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices, texts, written

BUCKETS = 128
BOUND = 256
CHUNK = 1 << 20


def bucket_counts(many: list[bytes]):
    """counts[i, b]: windows of text i that hash into bucket b."""
    import numpy as np
    sizes = np.fromiter(map(len, many), dtype="int64", count=len(many))
    counts = np.zeros(len(many) * BUCKETS, dtype="int64")
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(many), dtype="uint8")
    owner = np.repeat(np.arange(len(many), dtype="int32"), sizes)
    for lo in range(0, max(0, len(data) - 2), CHUNK):
        hi = min(lo + CHUNK, len(data) - 2)
        x = data[lo:hi].astype("uint32")
        x |= data[lo + 1:hi + 1].astype("uint32") << np.uint32(8)
        x |= data[lo + 2:hi + 2].astype("uint32") << np.uint32(16)
        own = owner[lo:hi]
        whole = np.arange(lo + 2, hi + 2) < ends[own]       # not across two texts
        slot = own.astype("int64") * BUCKETS + ((x * np.uint32(0x9E3779B1)) >> np.uint32(25))
        first = int(own[0]) * BUCKETS
        part = np.bincount(slot[whole] - first)
        counts[first:first + len(part)] += part
    return counts.reshape(-1, BUCKETS), sizes


def digests(many: list[str]):
    """One row of 34 byte values per text: 32 of codes, length, ratios."""
    import numpy as np
    counts, sizes = bucket_counts([t.encode("utf-8") for t in many])
    order = np.sort(counts, axis=1)
    q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype("uint8").reshape(len(many), -1, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    length = np.minimum(255, np.round(8 * np.log2(1 + sizes))).astype("uint8")
    low = (15 * q[:, 0] // np.maximum(q[:, 2], 1)).astype("uint8")
    mid = (15 * q[:, 1] // np.maximum(q[:, 2], 1)).astype("uint8")
    return np.concatenate([packed, length[:, None], (low << 4 | mid)[:, None]], axis=1)


def likeness(a, b):
    """Likeness, 0 to 1, of the digests in each row of ``a`` and ``b``."""
    import numpy as np

    def codes(x):
        p = x[:, :BUCKETS // 4, None] >> np.array([6, 4, 2, 0], dtype="uint8") & 3
        return p.reshape(len(x), -1).astype("int64")

    d = np.abs(codes(a) - codes(b))
    score = d.sum(axis=1) + 3 * (d == 3).sum(axis=1)
    a, b = a.astype("int64"), b.astype("int64")
    score += np.minimum(32, np.abs(a[:, -2] - b[:, -2]))
    score += np.abs((a[:, -1] >> 4) - (b[:, -1] >> 4)) + np.abs((a[:, -1] & 15) - (b[:, -1] & 15))
    return 1 - np.minimum(score, BOUND) / BOUND


def hexed(rows) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def edit(text: str, following: str) -> str:
    """``text`` with its second half (code points, rounded down) replaced by as
    many, or all, of the first code points of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def compare(own: list[str], following: list[str]) -> list[pa.Array]:
    """The columns FIELDS for texts and their successors."""
    import hashlib
    edited = [edit(t, f) for t, f in zip(own, following)]
    a, b, c = digests(own), digests(following), digests(edited)
    return [pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
            pa.array(hexed(a)), pa.array(hexed(c)), pa.array(likeness(a, c)), pa.array(likeness(a, b))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexed(digests(b.column(1).to_pylist())))],
                                             names=["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, its edited text's, and their likeness to each
    other and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, held_id, held = TaskContext.get().partitionId(), None, None
        names = ["doc_id", *FIELDS, "part", "edge", "text"]

        def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
            types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [doc_id, *[pa.nulls(1, t) for t in types], pa.array([part], pa.int32()),
                 pa.array([kind], pa.int32()), pa.array([text])], names=names)

        for b in slices(batches, "text", CHUNK):
            ids, own = b.column(0), b.column(1).to_pylist()
            if held is None:
                yield edge(1, ids.slice(0, 1), own[0])
            else:
                ids, own = pa.concat_arrays([held_id, ids]), [held, *own]
            n = len(own) - 1
            held_id, held = ids.slice(n, 1), own[n]
            if n:
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(0, n), *compare(own[:n], own[1:]), pa.array([part] * n, pa.int32()),
                     pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        if held is not None:
            yield edge(2, held_id, held)

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *compare(b.column(1).to_pylist(), b.column(2).to_pylist())],
                names=["doc_id", *FIELDS])

    d = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    rows = written(d.mapInArrow(run, f"{SCHEMA}, part int, edge int, text string"), "fingerprints")
    first = rows.where("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    order = Window.orderBy("part")        # one row per partition
    last = (rows.where("edge = 2").select("doc_id", "part", "text")
            .withColumn("next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))))
    edges = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(run_edges, SCHEMA)
    return rows.where("edge = 0").select("doc_id", *FIELDS).unionByName(edges)
