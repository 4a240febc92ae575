"""Helpers shared by the corpus operators.

Every operator reads only the columns it names (``id_col``, ``text_col`` ...),
under private names, so other columns of the input - whatever they are called -
are ignored and cannot clash with the operator's own.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

#: ASCII-only lower case and the word pattern of the text contracts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with NULL text as the empty text; everything else dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared work folder and read it back:
    later plans start from files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_table(spark: SparkSession, name: str) -> tuple[str, str, int]:
    """Name, folder and buckets of a table that ``bucketed`` can write."""
    path = fresh_dir(spark, name)
    return path.rsplit("/", 1)[1].replace("-", "_"), path, int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, to: tuple[str, str, int], by: str) -> DataFrame:
    """``df`` added to a table in the shared folder that is bucketed by a
    column: whatever is joined to it by that column is moved, and it is not."""
    name, path, buckets = to
    df.write.format("parquet").mode("append").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def pack(values) -> bytes:
    """Unsigned integers as byte planes, compressed."""
    import numpy as np
    values = np.asarray(values)
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view("uint8").reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes):
    import numpy as np
    width, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, dtype="uint64")
    planes = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * width, codec="zstd"), dtype="uint8")
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel().astype("uint64")


def worker_cache(key, make):
    """``make()`` once per Python worker process, kept across tasks.  The
    library's functions travel by value, so module globals would not last."""
    mod = sys.modules.setdefault("_freshstream_worker_cache", types.ModuleType("_freshstream_worker_cache"))
    store = mod.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that ``column`` (string or binary) holds about
    ``limit`` bytes in each; one longer value is a slice of its own."""
    import numpy as np
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        c = b.column(b.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype="int64")
        ends, lo = np.cumsum(sizes), 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
