import zlib

import numpy as np
from conftest import SF_MID
from pyspark.sql import functions as F

from freshstream.llm import quality
from freshstream.llm.common import table
from freshstream.llm.queries import QUERIES


def auc(y, s):
    order = np.argsort(np.argsort(s))
    good = (y == 1).sum()
    return (order[y == 1].sum() - good * (good - 1) / 2) / (good * (y == 0).sum())


def test_held_out_accuracy(spark):
    got = QUERIES["op10_pu_quality"](spark, SF_MID)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "held_out:boolean", "score:double",
                                                      "predicted:int"]
    got = got.toPandas()
    assert len(got) == table(spark, SF_MID, "documents").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    m = got.merge(table(spark, SF_MID, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.quality.values, m.score.values) > 0.95
    assert (m.predicted == m.quality).mean() > 0.93
    assert (m[m.quality == 1].predicted == 1).mean() > 0.97


def test_risk_stays_non_negative_and_uses_no_negatives():
    r = np.random.default_rng(0)
    good, bad = r.normal(1, 1, (4000, 2)), r.normal(-1.5, 1, (1000, 2))
    model = quality.fit_risk(good[:2000], np.concatenate([good[2000:], bad]), 2 / 3)
    z = [quality.indicators(x, model["cuts"]) @ np.array(model["weights"]) for x in (good, bad)]
    assert (z[0] > 0).mean() > 0.9 and (z[1] < 0).mean() > 0.85


def test_nulls_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "", 0.1), (2, None, None), (None, "some words", 0.2), (1, "", 0.1),
                                  (5, "x" * 100_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 0), (2, 0, 0), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = docs.select(quality.score_column(model, F.col("text")).alias("s")).collect()
    assert len(rows) == 5 and all(0 <= r.s <= 1 for r in rows)
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert none["prior"] == 0.5 and docs.limit(0).select(quality.score_column(none, F.col("text"))).count() == 0
    assert docs.select(quality.score_column(none, F.col("text")).alias("s")).first().s == 0.5
