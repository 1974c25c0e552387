"""Fleet telemetry jobs on Spark."""
