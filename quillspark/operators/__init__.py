"""Relational, retrieval, graph, telemetry and journal operators over DataFrames."""
