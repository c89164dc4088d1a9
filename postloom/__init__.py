"""postloom: clean, embed, cluster and classify large collections of short posts on Spark.

Every public function takes and returns DataFrames (or Columns).  Functions that run
inside Python tasks travel with the task, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
