"""Term functions as Spark columns."""
