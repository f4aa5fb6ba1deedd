"""relmon: data-reliability monitoring on Spark DataFrames.

Metric series, statistical baselines, z-score detection, freshness, data
contracts, alerts and health scorecards, all built from DataFrame / SQL /
Structured Streaming operators.  Every public operator takes DataFrames and
returns a lazy DataFrame; nothing is collected to the driver.
"""

from relmon.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
