"""Operators for preparing training data, with their registered queries."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from corpuslens.llm.queries import ORACLES, QUERIES  # noqa: E402

__all__ = ["QUERIES", "ORACLES"]
