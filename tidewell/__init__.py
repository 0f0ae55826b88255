"""Tidewell: streaming-SQL semantics and table operators expressed as Spark DataFrames.

Every operator is a DataFrame-to-DataFrame function; the SQL front end and the
Structured Streaming drivers are thin layers over those functions.
"""

__version__ = "0.1.0"
