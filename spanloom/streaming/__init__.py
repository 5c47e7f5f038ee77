"""Extension: incremental category times over event-time windows."""
