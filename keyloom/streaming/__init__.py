"""Change streams and watches on Structured Streaming."""
