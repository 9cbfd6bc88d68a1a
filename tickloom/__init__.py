"""tickloom: market and event time-series analytics written for Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``) built from Spark SQL expressions, joins, aggregates, windows
and Spark ML.
"""
