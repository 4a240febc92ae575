"""The thin ``opN_<name>`` queries: each applies one operator of this
subpackage, with production parameters, to its whole table and derives the
contract's digest columns from the operator's outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_semantics, fresh_dir
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_semantics(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file (installed on every node)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op9_bpe_rank_array")
def op9(spark, sf_dir):
    from .bpe import encode_decode
    out = encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op5_token_files")
def op5(spark, sf_dir):
    from . import tokenfiles
    docs = tokenfiles.in_document_order(table(spark, sf_dir, "documents"))
    out = tokenfiles.write(docs, fresh_dir(spark, "token-files"), vocabulary("byte_bpe_50k.json"),
                           end_id=0, dtype="<u2")
    return tokenfiles.read(spark, out, "<u2").select(
        "doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


@query("op4_separator_scan")
def op4(spark, sf_dir):
    """Token counts of all documents, scanned from flat files without an
    index.  The separator is an id outside the vocabulary (65280)."""
    from . import separators, tokenfiles
    from .common import texts
    out = tokenfiles.write(texts(table(spark, sf_dir, "documents")), fresh_dir(spark, "flat-tokens"),
                           vocabulary("byte_bpe_50k.json"), end_id=0xFF00, dtype=">u2", specials_are_text=True)
    counts = separators.count(spark, out, end_id=0xFF00, dtype=">u2")
    return (counts.join(separators.document_ids(spark, out), ["part", "doc_in_part"])
            .select("doc_id", (F.col("n_tokens") - 1).alias("n_tokens")))


@query("op2_quartile_digest")
def op2(spark, sf_dir):
    from .fingerprint import with_successor
    return with_successor(table(spark, sf_dir, "documents"))


@query("op10_pu_quality")
def op10(spark, sf_dir):
    from . import quality
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return (docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
                        quality.score_column(model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


@query("op6_temperature_mix")
def op6(spark, sf_dir):
    """Every row of the mix: doc_id, source, its tokens, the pass and place in
    which it is drawn, and its source's weight."""
    from .mixing import mix, token_count
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"),
                       F.col("_pass").alias("pass"), F.col("_order").alias("place"),
                       F.col("_weight").alias("weight"))


@query("op8_backoff_automaton")
def op8(spark, sf_dir):
    from .backoff_lm import score
    return score(table(spark, sf_dir, "documents"))


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    from .ngram_join import join
    return join(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op7_pruned_graph")
def op7(spark, sf_dir):
    from .vector_graph import links
    return links(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op3_pii_boosting")
def op3(spark, sf_dir):
    from .pii import KINDS, find
    out = find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


@query("op11_repeated_capture")
def op11(spark, sf_dir):
    from .fill_in_middle import restore, transform
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    from . import conversation_repair as R
    given = R.conversation_rows(table(spark, sf_dir, "conversations"))
    rows = R.damage(given)
    found = written(R.audits(rows), "audits")        # read twice below
    texts = R.digests(R.repaired(rows, found)).toDF("text_conv", "sha256")
    convs = given.select("conv_id").distinct()
    counts = ["gaps", *R.COUNTED, "cost"]
    return (convs.join(found.withColumnRenamed("conv_id", "found_conv"),
                       F.col("conv_id").eqNullSafe(F.col("found_conv")), "left")
            .join(texts, F.col("conv_id").eqNullSafe(F.col("text_conv")), "left")
            .select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


@query("op13_hashed_ratio")
def op13(spark, sf_dir):
    from .quality_rules import judge
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
