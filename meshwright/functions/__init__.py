"""Column-level helpers and session utilities."""
