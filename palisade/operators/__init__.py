"""DataFrame-to-DataFrame operators over raw and enriched events."""
