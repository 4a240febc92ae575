"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to a power (1 / temperature) and
normalised; a power below 1 is flatter, one above 1 is steeper (for sources
whose own entropy is beyond the target).  The power is found by bisection - in
each pass one aggregate over the per-source table evaluates a whole grid of
powers and keeps the bracket - so that the weights' entropy reaches
``target_entropy`` (a share of the largest possible, log of the number of
sources), but no source is repeated more than ``max_repeats`` times within the
budget: where that limit binds, it sets the power.

The weights become rows as budgeted permutations: a source with quota q (its
weight times the token budget) gets floor(q / tokens) whole passes over its
documents and one partial pass: the first documents of its permutation (order
of a seeded hash of doc_id) whose tokens together stay within the rest of the
quota.  The cut is found by blocks: the hash range is dealt into blocks of
about ``BLOCK_ROWS`` rows, block sums are scanned in two levels, and only
inside a block are rows put in order, so no source, however large, is ordered
in one task.  Per source this leaves two numbers (whole passes, the hash of the
last row taken), which every document is held against.

The mix misses a source's quota by less than one document (more only where
rows share a hash, that is, repeated doc_ids: they are in or out together).

Edge cases: NULL source is a source of its own; NULL and empty texts have no
tokens and take part in whole passes only if their source has tokens; NULL
doc_ids share one place in the permutation; sources without tokens get no
weight and no rows; an empty table gives an empty mix.  Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import bounded_broadcast
from .common import written

BLOCK_ROWS = 128
SUPER = 1024
GRID = 64
PASSES = 5
MOST_DOUBLES = 40            # up to powers of 2 ** 39


def token_count(text):
    """Words of a text (separators as in the text contracts)."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
            - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def place(id_col: str, seed: int):
    """A row's place in its source's permutation: 62 hash bits, uniform."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 2)


def key_of(source):
    """A source as a join key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("NULL"))


def curve(shares: DataFrame, budget_ratio: float, low: float, high: float) -> list:
    """Entropy (share of the largest) and largest repetition of GRID + 1 powers."""
    powers = F.array(*[F.lit(low + (high - low) * i / GRID) for i in range(GRID + 1)])
    each = shares.select("share", F.explode(powers).alias("power"))
    # relative to the largest share: no sum of weights underflows at large powers
    top = F.lit(shares.agg(F.max("share").alias("m")).first().m or 1.0)
    each = each.withColumn("share", F.col("share") / top).withColumn("w", F.pow("share", "power"))
    budget_ratio = F.lit(budget_ratio) / top
    rows = each.groupBy("power").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("share")).alias("wl"), F.count("*").alias("n"),
        (F.max(F.col("w") / F.col("share")) * budget_ratio / F.sum("w")).alias("repeats"))
    out = []
    for r in rows.orderBy("power").collect():             # GRID + 1 rows
        import math
        entropy = math.log(r.z) - r.power * r.wl / r.z
        out.append((r.power, entropy / math.log(r.n) if r.n > 1 else 1.0, r.repeats))
    return out


def temperature(shares: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float) -> float:
    """The smallest power that is at or below the target entropy and within
    the repetition limit.  If none is (the limit forbids so steep a mix, or
    shares are equal, so no power changes them), the steepest one from 1 up
    that is within the limit; 1 (the sources' own shares) if that is beyond it."""
    low, high, reach, kind = 0.0, 1.0, 1.0, None
    fine = lambda h, rep: h <= target_entropy + 1e-12 and rep <= max_repeats + 1e-12
    for _ in range(MOST_DOUBLES):
        points = curve(shares, budget_ratio, low, high)
        if not points:
            return 1.0
        if any(fine(h, rep) for _, h, rep in points):
            kind = fine
            break
        if points[-1][2] > max_repeats + 1e-12:      # the limit binds between here and there
            break
        low, high, reach = high, 2 * high, high
        if points[-1][1] >= points[0][1] and points[-1][0] > 1:      # equal shares: a power does nothing
            return 1.0
    if kind is None:                                  # steepest power within the limit
        low, high = reach, max(high, reach)
        for _ in range(PASSES):
            points = curve(shares, budget_ratio, low, high)
            within = [p for p, _, rep in points if rep <= max_repeats + 1e-12]
            low = max(within, default=low)
            high = min((p for p, _, _ in points if p > low), default=high)
            if not within or low == points[-1][0]:
                break
        return low
    for _ in range(PASSES):
        points = curve(shares, budget_ratio, low, high)
        high = min((p for p, h, rep in points if fine(h, rep)), default=high)
        low = max((p for p, _, _ in points if p < high), default=low)
        if high == points[0][0]:
            break
    return high


def weights(per_source: DataFrame, target_entropy: float = 0.9, max_repeats: float = 4.0,
            budget_ratio: float = 1.0) -> DataFrame:
    """Per source with tokens: source, docs, tokens, share, weight, quota."""
    total = per_source.agg(F.sum("tokens").alias("t")).first().t or 0
    if not total:
        return per_source.where("false").selectExpr("source", "docs", "tokens", "0D share", "0D weight", "0D quota")
    shares = per_source.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total)))
    power = temperature(shares, target_entropy, max_repeats, budget_ratio)
    top = F.lit(shares.agg(F.max("share").alias("m")).first().m)
    z = shares.agg(F.sum(F.pow(F.col("share") / top, F.lit(power))).alias("z")).first().z
    return (shares.withColumn("weight", F.pow(F.col("share") / top, F.lit(power)) / F.lit(z))
            .withColumn("quota", F.col("weight") * F.lit(float(total) * budget_ratio)))


def plan(docs: DataFrame, target_entropy: float, max_repeats: float, budget_ratio: float, seed: int,
         id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per source (its key): weight, quota, tokens, passes (whole ones), last (place of
    the last row of the partial pass; NULL: no row)."""
    light = written(docs.select(key_of(F.col(source_col)).alias("source"),
                                place(id_col, seed).alias("place"),
                                token_count(F.col(text_col)).alias("n")), "mixing-rows")
    per_source = written(light.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")),
                         "mixing-sources")
    w = written(weights(per_source, target_entropy, max_repeats, budget_ratio), "mixing-weights")
    w = w.withColumn("passes", F.floor(F.col("quota") / F.col("tokens") + 1e-9))
    w = w.withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
    rows = light.count()
    blocks = max(1, rows // BLOCK_ROWS)
    block = F.floor(F.col("place") / (2 ** 62 / blocks)).cast("long")
    light = light.withColumn("block", block)
    sums = light.groupBy("source", "block").agg(F.sum("n").alias("n")).withColumn(
        "super", F.floor(F.col("block") / SUPER))
    before = (Window.unboundedPreceding, -1)
    supers = sums.groupBy("source", "super").agg(F.sum("n").alias("n"))
    supers = supers.select("source", "super", F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("super").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "super").orderBy("block").rowsBetween(*before)
    sums = sums.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sums = sums.join(supers, ["source", "super"]).select(
        "source", "block", "n", (F.col("at") + F.col("base")).alias("at"))
    # whole blocks inside the rest of the quota, and the block that holds the cut
    quota = bounded_broadcast(w.select("source", "rest"))
    cut = sums.join(quota, "source").where("at <= rest")
    full = cut.where("at + n <= rest").groupBy("source").agg(F.max("block").alias("full"))
    edge = cut.where("at + n > rest").select("source", "block", "at", "rest")
    e = light.join(edge, ["source", "block"])
    upto = Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    e = (e.withColumn("upto", F.col("at") + F.sum("n").over(upto)).where("upto <= rest")
         .groupBy("source").agg(F.max("place").alias("edge_last")))
    f = full.select("source", (F.ceil((F.col("full") + 1) * F.lit(2 ** 62 / blocks)) - 1).cast("long").alias("full_last"))
    out = w.join(f, "source", "left").join(e, "source", "left")
    return written(out.select("source", "tokens", "share", "weight", "quota", "passes",
                              F.greatest("full_last", "edge_last").alias("last")), "mixing-plan")


def mix(docs: DataFrame, target_entropy: float = 0.9, max_repeats: float = 4.0, budget_ratio: float = 1.0,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: rows of ``docs`` once for each time they are taken, with
    ``_pass`` (0, 1, ...), ``_order`` (place in that pass, to sort by) and
    ``_weight`` (the source's) behind the input's columns.  An input column of one
    of these three names gives way to the mix's own; all others stay."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()])
    doc_id = names[id_col]
    p = plan(docs, target_entropy, max_repeats, budget_ratio, seed, id_col, text_col, source_col)
    p = bounded_broadcast(p.select(F.col("source").alias("_source"), F.col("passes").alias("_passes"),
                                   F.col("last").alias("_last"), F.col("weight").alias("_weight")))
    taken = F.col("_passes") + F.when(place(doc_id, seed) <= F.col("_last"), 1).otherwise(0)
    rows = own.join(p, key_of(F.col(names[source_col])) == F.col("_source"))
    rows = rows.withColumn("_taken", taken.cast("int")).where("_taken > 0")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_pass"), F.col(doc_id)), 2)
    kept = [c for c in docs.columns if c not in ("_pass", "_order", "_weight")]
    return rows.select(*[F.col(names[c]).alias(c) for c in kept], "_pass", order.alias("_order"), "_weight")
