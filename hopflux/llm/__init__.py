"""Training-data operators: each module holds one operator and its general interface.

Nothing outside this subpackage imports it; it can be deleted and the graph engine still works.
"""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors with the tasks: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
