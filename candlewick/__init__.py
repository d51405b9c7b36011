"""candlewick: OHLCV bar analytics as Spark DataFrame operators.

Every operator takes a DataFrame of many symbols at once and returns a
DataFrame; ordering inside a symbol is always explicit (``dt``), never
positional.  See README.md for the operator map.
"""

__version__ = "0.1.0"
