"""Column-level helpers (metrics, null rules, calendar buckets)."""
