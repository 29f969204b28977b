"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

One module per operator, each with a general DataFrame -> DataFrame interface; the thin
``opN_*`` queries with their fixed contracts are in ``queries``. Nothing outside this
package imports it.

The functions that run inside tasks are shipped by value, so executors need the public
libraries (numpy, pyarrow, xxhash) but not this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
