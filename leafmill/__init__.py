"""A PySpark-native engine for bulk document transcription and translation workflows."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: functions that they run travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
