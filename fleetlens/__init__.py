"""fleetlens: telemetry analytics for a fleet of PostgreSQL servers, on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Server and poll
keys are ordinary columns, so one job covers a whole fleet and its history.
"""
