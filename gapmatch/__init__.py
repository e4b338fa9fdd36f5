"""gapmatch: explainable skill extraction, matching and gap analysis on Spark.

Every job is a function from DataFrames to a DataFrame; see README.md for the
operator map.
"""

__version__ = "0.1.0"
