"""Evidence-grounded analytics over long documents, as Spark DataFrame operations."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a job does
# not depend on the package being installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
