"""Event logs: layouts that queries run on, and the XES format."""
