"""Operators for large training-data pipelines. Nothing outside this subpackage imports it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
