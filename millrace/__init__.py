"""millrace: a PySpark-native engine for change-risk datasets.

Every operator is a function from DataFrames to DataFrames.  Plans are
declared with the DataFrame API so that Catalyst and AQE choose the
physical strategy; Python runs only where a built-in cannot express the
operator, and then over Arrow batches.
"""

__version__ = "0.1.0"
