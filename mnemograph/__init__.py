"""Event-sourced graph-memory analytics on Spark.

The append-only event log is the only truth; every table, graph, score and
report is a DataFrame derived from it and an explicit ``as_of`` time.
"""
