"""Query catalogue over the supplied tables."""
