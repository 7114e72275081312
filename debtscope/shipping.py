"""Make the Python tasks independent of what is installed on the executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Send the functions of this module with the task instead of importing it there."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
