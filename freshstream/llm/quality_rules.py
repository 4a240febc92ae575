"""Quality rules: hashed n-gram log-likelihood ratio, native expressions only.

Words and word pairs are hashed into ``buckets`` slots.  Two multinomials over
the slots, smoothed by ``pseudo`` counts each, describe the trusted target and
the raw corpus: the raw counts are those of every document, the target counts
those of the trusted documents.  A document's score is the mean over its n-grams
of ``log p_target - log p_raw`` (length-normalised); it passes where the score
is at least the threshold.  That comes from the scores of trusted documents that
were left out of the target counts: as far below a low quantile of them as that
quantile lies below their median (times ``slack``), so that clean documents
unlike most trusted ones stay.  Scores are sums of whole millionths, so they do
not depend on the order of addition.

Ahead of it stand plain rules (``with_facts``): too few words, or too many words
inside repeated three-word windows.

Scale: the corpus is read three times (counts, trusted texts, scores).  Counts are
combined in each task into at most ``buckets`` rows; the ratio table (``buckets``
rows, a parameter) is broadcast; scores are combined in each task, one row per
document crosses the shuffle.  Every trusted document counts: its id is broadcast
while all ids together are small enough (``bounded_broadcast``), beyond that texts
and ids meet in a shuffle.  Quantiles are exact: scores are counted by slices, and
only the slices that hold them are read by value.

Defined results: NULL and empty texts have no words and fail the rules.  Several
labels of one doc_id count by their mean (>= 0.5 is trusted), NULL labels not at
all; NULL doc_ids are never trusted and are scored.  Repeated rows are judged
row by row.  Without trusted documents the rules alone decide.  Texts of any
length are taken whole.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import written

SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
#: A score is kept in whole millionths.
UNIT = 1_000_000
#: Slices a score unit is cut into where quantiles are looked for.
SLICES = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def windows(words: Column) -> Column:
    """Hashes of the three-word windows, in order."""
    last = F.size(words) - 3
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def covered(starts: Column) -> Column:
    """Number of words in windows of three that begin at ``starts`` (ascending)."""
    width = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(width, F.lit(0).cast("bigint"), lambda total, w: total + w)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more in the text."""
    def several(hashes):
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(rows, lambda r: let(F.sort_array(F.transform(
            F.filter(r, lambda x, k: F.coalesce((k > 0) & (F.get(r, k - 1)["h"] == x["h"]), F.lit(False))
                     | F.coalesce(F.get(r, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])), covered))
    return let(windows(words), lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(several(hashes)))


def grams(words: Column, buckets: int = BUCKETS) -> Column:
    """Slots of the words and of the pairs of neighbours."""
    slot = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    one = F.transform(words, lambda w: slot(F.xxhash64(w)))
    pairs = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    next_ = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(one, F.zip_with(pairs, next_, lambda a, b: slot(F.xxhash64(a, b))))


def with_facts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id and the plain counts of its text, with the slots of its n-grams.
    Words are cut out once for all of them."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    facts = docs.select(
        "doc_id",
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
            grams(w, buckets).alias("slots"))).alias("of_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))
    return facts.select("doc_id", "of_words.n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "of_words.n_repeat_words", "of_words.slots")


def trusted_ids(labels: DataFrame, id_col: str, quality_col: str, max_trusted: int | None = None) -> DataFrame:
    """Ids of the trusted documents (all, or for a caller that wants few the
    ``max_trusted`` of least hash), with ``fit`` (four of five) or not."""
    h = F.xxhash64(F.col("t_id"), F.lit("trusted"))
    ids = (labels.select(F.col(id_col).alias("t_id"), F.col(quality_col).alias("q"))
           .where("t_id IS NOT NULL AND q IS NOT NULL").groupBy("t_id").agg(F.avg("q").alias("q"))
           .where("q >= 0.5").select("t_id", h.alias("h")))
    if max_trusted is not None:
        ids = ids.orderBy("h", "t_id").limit(max_trusted)
    return ids.select("t_id", (F.pmod(F.xxhash64("h"), F.lit(5)) != 0).alias("fit"))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is one of ``ids`` (t_id)."""
    return rows.join(bounded_broadcast(ids.select("t_id")), F.col("doc_id") == F.col("t_id"), "left_semi")


def counted(texts: DataFrame, buckets: int) -> DataFrame:
    """slot, number of n-grams."""
    found = texts.select(F.explode(let(words_of(F.col("text")), lambda w: grams(w, buckets))).alias("slot"))
    return found.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int, pseudo: float) -> DataFrame:
    """slot -> log p_target - log p_raw, in whole millionths; every slot."""
    raw = counted(docs, buckets).toDF("slot", "raw")
    target = counted(among(docs, trusted.where("fit")), buckets).toDF("slot", "target")
    both = (docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
            .join(raw, "slot", "left").join(target, "slot", "left").na.fill(0))
    both = written(both, "gram-counts")
    sums = both.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    log = lambda c, total: F.log((F.col(c) + pseudo) / F.lit(float(total + pseudo * buckets)))
    ratio = F.round((log("target", sums["target"]) - log("raw", sums["raw"])) * UNIT).cast("bigint")
    return both.select("slot", (ratio if sums["target"] else F.lit(0).cast("bigint")).alias("ratio"))


def quantiles(rows: DataFrame, column: str, points: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column without NULLs, linear between neighbours (as
    ``percentile``, but no task holds all values); None where there are no rows."""
    part = F.floor(F.col(column) * SLICES)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in counts)
    if not total:
        return [None] * len(points)
    places = [p * (total - 1) for p in points]
    ranks = {f(x) for x in places for f in (math.floor, math.ceil)}
    first, seen = {}, 0                        # rank of the first value of each part that is needed
    for r in counts:
        if any(seen <= k < seen + r["n"] for k in ranks):
            first[r["part"]] = seen
        seen += r["n"]
    value = {}
    for r in (rows.where(part.isin(list(first))).groupBy(part.alias("part"), F.col(column).alias("v"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy("part", "v").collect()):
        begin, first[r["part"]] = first[r["part"]], first[r["part"]] + r["n"]
        value.update({k: r["v"] for k in ranks if begin <= k < begin + r["n"]})
    return [value[lo] if lo == hi else (hi - x) * value[lo] + (x - lo) * value[hi]
            for x, lo, hi in ((x, math.floor(x), math.ceil(x)) for x in places)]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          quality_col: str = "quality", min_words: int = 50, max_repeat_percent: int = 50, buckets: int = BUCKETS,
          pseudo: float = 1.0, quantile: float = 0.005, slack: float = 1.0) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, threshold, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trusted = written(trusted_ids(labels, id_col, quality_col), "trusted")
    table = written(ratios(docs, trusted, buckets, pseudo), "gram-ratios")
    facts = with_facts(docs, buckets).withColumn("row", F.monotonically_increasing_id())
    keys = [c for c in facts.columns if c != "slots"]
    scored = (facts.select(*keys, F.explode_outer("slots").alias("slot"))
              .join(F.broadcast(table), "slot", "left").groupBy(*keys)
              .agg(F.coalesce(F.sum("ratio"), F.lit(0)).alias("total"), F.count("slot").alias("n_grams")))
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    mean = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / UNIT).otherwise(F.lit(0.0))
    scored = written(scored.select("*", failed.alias("base_failed"), mean.alias("score"))
                     .drop("row", "total", "n_grams"), "scored")
    held = written(among(scored.where("NOT base_failed"), trusted.where("NOT fit")).select("score"), "held-scores")
    low, middle = quantiles(held, "score", (quantile, 0.5))
    bound = float("-inf") if low is None else low - slack * (middle - low)
    return scored.select("*", F.lit(bound).alias("threshold"),
                         (~F.col("base_failed") & (F.col("score") >= F.lit(bound))).alias("kept"))
