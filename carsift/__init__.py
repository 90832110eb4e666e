"""carsift: used-vehicle listing analytics as PySpark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# the few Python helpers that run inside tasks travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
