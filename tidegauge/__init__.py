"""Point-in-time market analytics as Spark DataFrame operators."""
