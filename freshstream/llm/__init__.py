"""Corpus operators for training-data pipelines, and their registered queries."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
