"""Analytics over catalogue, telemetry, queue and image tables, written on Spark."""
