"""Bitemporal memory-graph analytics and corpus preparation on PySpark."""
