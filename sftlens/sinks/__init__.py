"""Sinks: JSONL writer, validated publish, comparison writer, output naming."""
