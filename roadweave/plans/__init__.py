"""Route and multi-day planning."""
