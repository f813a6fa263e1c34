"""Operators for training-data corpora: counting, deduplication, filtering, formatting, encoding.

The functions that run in tasks are shipped with the plan, so executors need not have this
package installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
