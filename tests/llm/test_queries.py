"""Every registered corpus query gives rows at the small scale."""

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from freshstream.llm import ORACLES, QUERIES

ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(set(ALL) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert ALL[name](spark, SF_SMALL).count() > 0
