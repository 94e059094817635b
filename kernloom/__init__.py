"""kernloom: group-wise multiple kernel learning on Spark DataFrames."""

__version__ = "0.1.0"
