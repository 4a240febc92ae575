"""freshstream: fresh-data analytics on event streams, written for Spark."""

import sys

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """The few Python functions of this package that run inside Spark's
    Python workers (the Q-C state processor, Arrow-batch helpers) are
    shipped with the task, pickled by value, so a worker does not need to
    import the package: a driver started from any folder, without
    ``--py-files``, still runs them."""
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
