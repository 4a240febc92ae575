"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; everything else is only
unlabelled web text.  With the class prior p, the risk of a score function is
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``: the part in
``max`` estimates the risk on the unseen negatives without bias, and where a
mini-batch drives it below 0 the step goes back up on that part alone.  The
prior is the share of quality 1 among the labelled rows of the learning folds.

A text's features are shares that do not depend on its length (character
classes, repetition inside windows of words, line repetition, mixture of
function words of several languages ...), cut at quantiles of the unlabelled
sample into indicator columns, under a linear score.  labels, lang, source and
doc_id are never features.

Fitting reads a bounded sample: at most ``max_positive`` positives and about
``max_unlabelled`` unlabelled rows, chosen by a hash of doc_id; every row is
scored, inside Spark tasks.  Only learning folds (crc32 of doc_id modulo
``folds`` is not ``held_out_fold``) are read for either.

Edge cases: NULL and empty texts are scored like any text (all shares 0);
rows with NULL doc_id are scored, never learnt from, and count as not held
out; several labels of one doc_id count by their mean (>= 0.5 is positive),
NULL labels not at all; with no positive or no unlabelled rows every score is
the prior (0.5 without labels).  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 50
#: Fixed lists: frequent function words of the languages told apart.
FUNCTION_WORDS = [frozenset(x.split()) for x in (
    "the of and to in a is that for it was on be with by as are at this from",
    "le la de et les des un une du en que dans qui sur par au pour est pas il",
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "de la que el en y a los se del las un por con una para es lo al como")]
NAMES = ["upper", "lower", "digit", "space", "newline", "exclaim", "pipe", "symbol", "quote", "stop", "foreign",
         "word_len", "long_word", "one_letter", "distinct", "top_word", "adjacent", "bigrams", "line_words",
         "line_repeats", "function", "mixture", "title", "all_caps", "odd_end", "length"]


def features(text: str | None) -> list[float]:
    import numpy as np
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8"), dtype="uint8"), minlength=256)
    n = max(1, int(raw.sum()))
    words = text.split()
    w = max(1, len(words))
    of = lambda chars: float(raw[np.frombuffer(chars, dtype="uint8")].sum()) / n
    distinct = bigrams = mixed = spoken = 0.0
    for lo in range(0, len(words), WINDOW_WORDS):
        part = words[lo:lo + WINDOW_WORDS]
        distinct += len(set(part))
        bigrams += len(set(zip(part, part[1:]))) + 1
        hits = [sum(map(f.__contains__, part)) for f in FUNCTION_WORDS]
        spoken += max(hits)
        mixed += sum(hits) - max(hits)
    counted = Counter(words)
    lines = [x for x in text.split("\n") if x]
    ends = Counter(x[-1] for x in words)
    return [
        float(raw[65:91].sum()) / n, float(raw[97:123].sum()) / n, float(raw[48:58].sum()) / n, of(b" "), of(b"\n"),
        of(b"!"), of(b"|"), of(b"#$%&*@^~<>{}[]\\/=_+"), of(b"\"'`"), of(b".,;:?"), float(raw[128:].sum()) / n,
        sum(map(len, words)) / w, math.log1p(max(map(len, words), default=0)),
        sum(len(x) == 1 for x in words) / w, distinct / w, max(counted.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, bigrams / w,
        math.log1p(w / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        spoken / w, mixed / max(1.0, mixed + spoken),
        sum(x[0].isupper() for x in words) / w, sum(x.isupper() for x in words) / w,
        sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,;:?") / w, math.log1p(w)]


def indicators(x, cuts):
    """Cumulative indicators: column (f, c) is 1 where feature f exceeds its
    c-th cut, after a constant."""
    import numpy as np
    return np.concatenate([np.ones((len(x), 1)),
                           *[(x[:, i:i + 1] > np.asarray(c)[None, :]) for i, c in enumerate(cuts)]],
                          axis=1).astype("float32")


def fit_risk(positive, unlabelled, prior: float, steps: int = 800, rate: float = 0.03, penalty: float = 1e-4,
             bins: int = 12, batch: int = 1024, seed: int = 11) -> dict:
    """Minimise the non-negative risk with logistic loss by Adam."""
    import numpy as np
    grid = np.concatenate([np.linspace(0, 1, bins + 1)[1:-1], [0.01, 0.02, 0.95, 0.97, 0.99]])
    cuts = [np.unique(np.quantile(unlabelled[:, i], grid)).tolist() for i in range(unlabelled.shape[1])]
    p, u = indicators(positive, cuts), indicators(unlabelled, cuts)
    rng, wt = np.random.default_rng(seed), np.zeros(p.shape[1])
    m, v = np.zeros_like(wt), np.zeros_like(wt)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        za, zb = a @ wt, b @ wt
        up = -prior * (a * (1 - sigmoid(za))[:, None]).mean(axis=0)          # of p R+
        unseen = (b * sigmoid(zb)[:, None]).mean(axis=0) - prior * (a * sigmoid(za)[:, None]).mean(axis=0)
        risk = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        g = (up + unseen if risk >= 0 else -unseen) + penalty * wt
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        wt = wt - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return {"cuts": cuts, "weights": wt.tolist(), "prior": prior}


def features_udf():
    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(features)
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3,
        held_out_fold: int = 1, max_positive: int = 12_000, max_unlabelled: int = 24_000) -> dict:
    """Fit on a bounded sample of the learning folds."""
    import numpy as np
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != held_out_fold
    truth = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
             .where(F.col("q").isNotNull() & learn).groupBy("doc_id").agg((F.avg("q") >= 0.5).alias("good")))
    known = truth.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).first()
    if not known.n or not known.good:
        return {"cuts": [], "weights": [], "prior": (known.good or 0) / known.n if known.n else 0.5}
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20))
    total = own.where(learn).agg(F.count("*").alias("n")).first().n
    share = lambda most, n: F.lit(int((1 << 20) * min(1.0, most / max(1, n))))
    # at most about max_positive ids: a small side by construction
    trusted = truth.where("good").where(draw < share(max_positive, known.good)).select("doc_id").withColumn("p", F.lit(1))
    marked = own.where(learn).join(F.broadcast(trusted), "doc_id", "left")
    sample = marked.where(F.col("p").isNotNull() | (draw < share(max_unlabelled, total)))
    got = (sample.select(F.col("p").isNotNull().alias("p"), (draw < share(max_unlabelled, total)).alias("u"),
                         features_udf()("text").alias("x")).collect())
    pos = np.array([r.x for r in got if r.p], dtype="float64")
    unl = np.array([r.x for r in got if r.u], dtype="float64")
    prior = known.good / known.n
    if not len(pos) or not len(unl):
        return {"cuts": [], "weights": [], "prior": prior}
    return fit_risk(pos, unl, prior)


def score_column(model: dict, text: Column) -> Column:
    """The model's probability that the text is of quality 1."""

    @F.pandas_udf("double")
    def run(many: pd.Series) -> pd.Series:
        import numpy as np
        if not model["weights"]:
            return pd.Series([model["prior"]] * len(many), dtype="float64")
        out = []
        for lo in range(0, len(many), 512):
            x = np.array([features(t) for t in many.iloc[lo:lo + 512]], dtype="float64")
            z = indicators(x, model["cuts"]) @ np.asarray(model["weights"])
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return run(text)
