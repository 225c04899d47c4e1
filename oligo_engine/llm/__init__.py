"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load():
    """(queries, sql) by name."""
    from oligo_engine.llm import queries

    return queries.QUERIES, queries.SQL
