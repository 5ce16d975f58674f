"""Live logs with Structured Streaming."""
