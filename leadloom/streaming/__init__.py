"""The batch operators inside Structured Streaming."""
