"""Spark-native content search and search analytics.

Every operator takes and returns DataFrames (or is a Column expression) and
leaves scheduling, joins, shuffles and state to Spark.
"""
