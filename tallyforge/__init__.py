"""Evaluation, catalogue and monitoring analytics for model programmes, on Spark.

Every operator is a function from DataFrames to a DataFrame.
"""
