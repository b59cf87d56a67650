"""quire: document-layout analytics and corpus operators as lazy PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
