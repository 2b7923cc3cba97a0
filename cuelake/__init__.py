"""cuelake: timed-text analytics as PySpark DataFrame operators."""
