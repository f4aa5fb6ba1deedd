"""relmon.streaming."""
