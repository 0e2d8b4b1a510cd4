"""Claims, peer and coverage analytics as plain DataFrame-to-DataFrame operators.

* ``functions``  column expressions, fixed values and row-level helpers
* ``sources``    readers, archive landing, sinks
* ``operators``  joins, aggregations and rankings over claim, peer and policy tables
* ``plans``      composite jobs that read, derive and write whole table sets
"""

import sys

from pyspark import cloudpickle

# The small Python helpers that run inside tasks travel with them, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
