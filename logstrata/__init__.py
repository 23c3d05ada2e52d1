"""logstrata: a PySpark-native engine for machine logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions shipped to Python workers carry their code along: nothing to install on executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
