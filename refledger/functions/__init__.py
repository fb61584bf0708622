"""Scalar functions; every one takes and returns native Spark Columns unless it says otherwise."""
