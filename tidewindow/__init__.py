"""Point-in-time event studies on time-series tables, written as Spark DataFrame operators."""
