"""tillbook: multi-account cash-ledger analytics on Spark DataFrames.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function
built on the DataFrame, SQL and Structured Streaming APIs.
"""

__version__ = "0.1.0"
