"""Query catalogue over the driver tables."""
