"""barline: market-bar and portfolio analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames. Series operators work on long tables keyed by
``(symbol, date)`` and run for all symbols at once.
"""

__version__ = "0.1.0"
