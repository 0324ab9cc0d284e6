"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Its Python helpers travel to the
executors by value, so a session whose executors lack the package still runs them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
