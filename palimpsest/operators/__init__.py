"""Operators on DataFrames: reads over time, retrieval, graphs, writes, queues, maintenance."""
