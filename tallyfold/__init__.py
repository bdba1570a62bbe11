"""tallyfold: seller & subscription analytics as PySpark jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions that Spark ships to executors (pandas folds, the fixture
# signer) are pickled with the package's code, so executors do not need an
# installed copy of tallyfold.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
