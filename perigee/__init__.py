"""Perigee: orbit-catalog and telemetry analytics expressed as Spark jobs."""
