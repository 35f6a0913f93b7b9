"""DataFrame operators over telemetry tables."""
