"""Readers of edges, vertices, parameters and configurations, and result sinks."""
