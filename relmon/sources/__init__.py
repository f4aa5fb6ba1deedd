"""relmon.sources."""
