"""The registry of queries that the engine is checked and measured by."""
