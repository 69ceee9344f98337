"""Transaction categorisation, reconciliation and review as Spark jobs."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with their tasks, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
