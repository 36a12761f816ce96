"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run inside tasks are
pickled by value, so executors need only Python, numpy and pyarrow, not this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
