"""bazaar: e-commerce analytics operators written on the PySpark DataFrame API.

Every operator takes DataFrames (and column names / parameters) and returns a
lazy DataFrame. Nothing is collected to the driver except bounded metadata
(a scalar, a list of range-partition statistics, the user's parameters).
"""

__version__ = "0.1.0"
