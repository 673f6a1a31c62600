"""Retail analytics on Spark: normalise an order export, check it, report on it."""
