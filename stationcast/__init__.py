"""PySpark operators for panels of daily readings from many stations.

Every operator is a ``DataFrame -> DataFrame`` function that can be chained with
``DataFrame.transform``. Order inside a series never comes from row position: it
is always spelled out through :mod:`stationcast.operators.ordered`.
"""

__version__ = "0.1.0"
