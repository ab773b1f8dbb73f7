"""Training-data operators: language ID, HTML extraction, decontamination,
toxicity, near, substring and exact dedup, secret scans, mixing, sharding.

Python functions that run on executors are pickled by value, with all modules of
this subpackage, so that the operators work on clusters where it is installed on
the driver only. Broadcast values hold builtins and arrays, no classes of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
