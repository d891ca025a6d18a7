"""Document profiling, synthesis, change logs and validation on Spark."""
