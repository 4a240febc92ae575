"""Named queries (``queries()``) and their oracle SQL (``oracle_sql()``)."""

from .registry import ORACLES, QUERIES


def load_all():
    """Import every plan module so its queries register themselves."""
    from . import batch, ingest, lag, streams, tiered  # noqa: F401
    return QUERIES, ORACLES
