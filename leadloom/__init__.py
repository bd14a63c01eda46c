"""Incremental lead matching over landed web pages, written as Spark jobs."""
