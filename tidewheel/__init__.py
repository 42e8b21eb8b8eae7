"""Spark-first analytics for dense daily person records."""
