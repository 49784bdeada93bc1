"""Column -> Column functions. All built from Spark built-ins; no Python UDF."""
