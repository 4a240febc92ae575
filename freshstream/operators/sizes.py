"""Table size report: rows, compressed / uncompressed bytes, ratio.

The file list of each table comes from Spark's file listing (the ``binaryFile``
source, one row per file, contents not read); footers are then read in parallel on the executors (``mapInArrow``
over the file list, one footer per file via pyarrow), so the work is
distributed by file and nothing passes through the driver.  Sizes are the
sums of the column-chunk sizes recorded in the footers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.format import readable_quantity, readable_size

FOOTER_SCHEMA = "table STRING, file STRING, rows BIGINT, compressed BIGINT, uncompressed BIGINT"


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    for b in batches:
        out = {"table": [], "file": [], "rows": [], "compressed": [], "uncompressed": []}
        for table, path in zip(b.column("table").to_pylist(), b.column("file").to_pylist()):
            u = urlparse(path)
            if u.scheme in ("", "file"):
                fs, p = pafs.LocalFileSystem(), unquote(u.path)
            else:
                fs, p = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(p) as f:
                md = pq.ParquetFile(f).metadata
            comp = unc = 0
            for i in range(md.num_row_groups):
                rg = md.row_group(i)
                for j in range(rg.num_columns):
                    c = rg.column(j)
                    comp += c.total_compressed_size
                    unc += c.total_uncompressed_size
            for k, v in (("table", table), ("file", path), ("rows", md.num_rows),
                         ("compressed", comp), ("uncompressed", unc)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("table", pa.string()), ("file", pa.string()), ("rows", pa.int64()),
            ("compressed", pa.int64()), ("uncompressed", pa.int64())]))


def table_sizes(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """tables: name -> parquet path.  One row per table.

    One row per file and nothing per data row; footers are read per file on
    executors."""
    listing = None
    for name, path in tables.items():
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
                 .option("recursiveFileLookup", "true").load(path)
                 .select(F.col("path").alias("file"), F.lit(name).alias("table")))
        listing = files if listing is None else listing.unionByName(files)
    footers = listing.select("table", "file").mapInArrow(_footers, FOOTER_SCHEMA)
    agg = footers.groupBy("table").agg(F.sum("rows").alias("rows"),
                                       F.sum("compressed").alias("compressed_bytes"),
                                       F.sum("uncompressed").alias("uncompressed_bytes"))
    return agg.select(
        "table", "rows", "compressed_bytes", "uncompressed_bytes",
        F.round(F.col("uncompressed_bytes").cast("decimal(38,6)")
                / F.col("compressed_bytes"), 2).cast("double").alias("ratio"),
        readable_quantity(F.col("rows")).alias("rows_readable"),
        readable_size(F.col("compressed_bytes")).alias("compressed"),
        readable_size(F.col("uncompressed_bytes")).alias("uncompressed"))
