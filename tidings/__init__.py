"""tidings — content digest and messaging analytics on PySpark.

Feed bodies, web pages and chat events in; ranked story tables, digests,
card payloads and outbox rows out.  Every operator is a function from
DataFrames to a DataFrame built from built-in Spark expressions.
"""

__version__ = "0.1.0"
