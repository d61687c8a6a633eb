"""Operators of a training-data pipeline over document, page and benchmark tables.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions of this subpackage with the job, installed there or not
cloudpickle.register_pickle_by_value(sys.modules[__name__])
