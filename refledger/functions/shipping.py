"""Lets executors run our UDFs without the package being installed on them."""

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of a module with the job instead of importing it on the workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
