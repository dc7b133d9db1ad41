"""The point-in-time feed as a stream."""
