"""Training-data operators: quality rules, tokenisation, language models, dedup, mixing, search.

Nothing else in the library imports this subpackage. Functions that run inside
tasks are shipped by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
