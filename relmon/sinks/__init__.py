"""relmon.sinks."""
