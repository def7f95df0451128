"""Wholesale and retail analytics expressed as Spark DataFrame jobs."""
