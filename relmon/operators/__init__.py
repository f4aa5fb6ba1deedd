"""relmon.operators: profiling, detection, contracts, alerts, scorecards."""
