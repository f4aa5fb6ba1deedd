"""relmon.plans."""
