"""Readers: each returns a DataFrame in one of the layouts of ``termweave.schemas``."""
