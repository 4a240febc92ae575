"""The corpus pipeline: five operators of ``freshstream.llm`` over documents.

1. quality          documents that the positive-unlabelled classifier rejects go
2. near_duplicates  one document of each group of near copies stays
3. pii              personal data is replaced by its kind
4. mix              sources are brought to their target weights
5. bpe              what is left becomes token ids

Every stage works on all its predecessor kept, which is written as Parquet and
read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshstream.llm import bpe, mixing, ngram_join, pii, quality
from freshstream.llm.common import table, written
from freshstream.llm.queries import vocabulary
from freshstream.session import ensure_semantics


def private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with nothing, and which is which."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()]), names


def public(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(c) for c, k in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own, names = private(docs)
    scored = own.withColumn("score", quality.score_column(model, F.col(names["text"])))
    return public(scored.where("score >= 0.5"), names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8 or more) the document
    of the smallest doc_id; repeated rows once.  Groups in which no row has a
    doc_id, and documents without words, stay as they are."""
    found = ngram_join.join(docs, words=5, percent=80)
    own, names = private(docs)
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("stay")).distinct()
    kept = own.join(stay, doc_id.eqNullSafe(F.col("stay")), "left_semi")
    once = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(F.lit(0))
    first = F.when(doc_id.isNull(), 1).otherwise(F.row_number().over(once))
    return public(kept.withColumn("first", first).where("first = 1"), names)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every selected span replaced; n_chars follows."""
    own, names = private(docs)
    out = pii.redact(own, names["text"])
    size = F.length(names["text"]).cast(docs.schema["n_chars"].dataType)
    return public(out.withColumn(names["n_chars"], size), names)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each pass that takes them."""
    own, names = private(docs)
    return public(mixing.mix(own, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"]), names)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    out = bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage),
          ("mix", mix_stage), ("bpe", bpe_stage)]

#: The classifier and the tokenizer are not expressible in SQL; the stages are
#: tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_semantics(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
