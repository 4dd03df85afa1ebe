"""Structural-variant analytics over paired-end alignments, written for PySpark.

Alignments, clip clusters, breakends, regions and calls are plain DataFrames;
every operator is a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
