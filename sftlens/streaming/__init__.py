"""Structured Streaming jobs: incremental sample ingest (ST1) and rolling telemetry peaks (ST2)."""
