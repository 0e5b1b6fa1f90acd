"""Record sources."""
