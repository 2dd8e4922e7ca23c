"""Postal-address reference data on Spark: feeds, versions, search, service levels."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions that run in tasks with the job, so that workers need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
