"""Make modules that define Python UDFs travel with the UDF itself.

Functions of an importable module are pickled by reference, so every executor would need the
package installed.  Registering the module for pickling by value sends the UDF code with the
task instead, so a job runs wherever only PySpark, NumPy and pandas are present.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
