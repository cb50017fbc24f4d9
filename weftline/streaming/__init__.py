"""Event feeds on Structured Streaming."""
