"""Bindings of the driver's tables to the engine's logical tables, and the query catalogue."""
