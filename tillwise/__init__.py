"""Retail analytics on Spark: operators over DataFrames and Columns."""
