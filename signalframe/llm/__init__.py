"""Training-data operators: self-contained modules and their registered queries.

Nothing outside this subpackage imports it. The functions that run on executors are
pickled by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
