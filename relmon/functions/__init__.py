"""relmon.functions."""
