"""A Spark-first analytics engine for star-schema data with a yearly time axis."""
