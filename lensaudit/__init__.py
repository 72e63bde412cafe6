"""Site-audit analytics on Spark: reachability, readability and answerability of web pages.

Python code that runs on executors is pickled by value, so a cluster needs no
installed copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
