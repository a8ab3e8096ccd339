"""Sources: driver tables, JSONL scans with error policies, manifests, telemetry."""
from .tables import read_table

__all__ = ["read_table"]
