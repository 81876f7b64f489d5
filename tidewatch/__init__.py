"""tidewatch: security-telemetry analytics as Spark DataFrame jobs.

Every operator is a plain function ``(DataFrames, params, now) -> DataFrame``.
Nothing is collected to the driver; all work is expressed with the
DataFrame API so Catalyst can prune, push down and plan the shuffles.
"""

__version__ = "0.1.0"
