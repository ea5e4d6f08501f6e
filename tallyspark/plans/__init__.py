"""The election view over the supplied tables and the query catalogue."""
