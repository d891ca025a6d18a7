"""Training-data operators. Nothing outside this package imports it; it may be deleted whole."""
